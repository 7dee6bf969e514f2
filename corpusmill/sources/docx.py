"""Paragraphs and tables of word-processor files, read with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _said(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t")).strip()


def blocks(content: bytes) -> list[tuple[int | None, list[str]]] | None:
    """Paragraphs (heading level or none, one text) and table rows (the cells) in order; None if it isn't such a file."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for node in [] if body is None else body:
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            name = "" if style is None else style.get(f"{W}val", "").lower().replace(" ", "")
            level = int(name[7:8]) if name.startswith("heading") and name[7:8].isdigit() else 2 if name.startswith("heading") else None
            if said := _said(node):
                out.append((level, [said]))
        elif node.tag == f"{W}tbl":
            for row in node.iter(f"{W}tr"):
                if cells := [c for c in map(_said, row.iter(f"{W}tc")) if c]:
                    out.append((None, cells))
    return out


def as_text(content: bytes | None) -> str | None:
    """Headings after `## `, the cells of a table row joined by ` | `."""
    found = None if content is None else blocks(bytes(content))
    return None if found is None else "\n".join(("## " if level else "") + " | ".join(said) for level, said in found)


def docx_text():
    """A column function: a file's bytes to its text, null if it can't be read."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(as_text).astype(object)

    return read


def docx_texts(files: DataFrame) -> DataFrame:
    """path, text of files (path, kind, content) of kind docx; empty if it can't be read."""
    rows = files.filter("kind = 'docx'")
    return rows.select("path", F.coalesce(docx_text()(F.col("content")), F.lit("")).alias("text"))


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        each = [(path, n, level, " ".join(said)) for path, content in zip(rows["path"], rows["content"], strict=True) for n, (level, said) in enumerate(blocks(bytes(content)) or [])]
        out = pd.DataFrame(each, columns=["path", "pos", "level", "text"])
        yield out.astype({"pos": "int64", "level": "Int32"})


def docx_blocks(files: DataFrame) -> DataFrame:
    """path, pos, level (of a heading's style, else null), text of files (path, kind, content) of kind docx."""
    return files.filter("kind = 'docx'").select("path", "content").mapInPandas(_blocks, "path string, pos long, level int, text string")

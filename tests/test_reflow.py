"""Logical lines against a plain scan that asks Spark for headings and titles."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import sections, structure

LINES = [
    "", "....", ".", "4.1", ".5.1.1", "7", "6.2.", "4.1 Context of it", "# Marked title", "## and no title", "# 8.1 Marked heading", "Scope", "the", "and", "was going", "a", "wrapped part of a line",
    "Understanding the organization", ". Customer focus", "A paragraph that is long enough not to be taken for a wrapped one, ending in an", "small start that goes on for more than forty-eight code points, too",
    "All rights reserved", "Licensed to somebody", "כללי", "ההנהלה הבכירה תפגין מנהיגות. כללי", "מערכת ניהול. איכות.  תכנון", "בקרה shall be", "1. 2", "Ends here. New one", "ééé", "Ünder",
]


class Asked(dict):
    """Answers that are still to be asked count as no."""

    def __init__(self):
        super().__init__()
        self.open = set()

    def __missing__(self, key):
        self.open.add(key)
        return False


def scanned(text: str, is_heading: Asked, is_title: Asked) -> list[str]:
    out, paragraph, waiting, mark = [], "", "", ""

    def title(id_, t):
        return bool(t) and is_title[t] and is_heading[f"{id_} {t}"]

    def close():
        nonlocal paragraph, waiting
        out.extend(x for x in (paragraph, waiting) if x)
        paragraph = waiting = ""

    for line in text.split("\n"):
        line = line.strip()
        line = "" if re.fullmatch(r"[.\s…·‧]+", line) else line.lstrip(".").strip()
        marked = re.match(structure.MARKED, line)
        if not line:
            if not waiting:
                close()
        elif marked and not is_heading[marked[1]]:
            mark = marked[1]
        elif is_heading[line]:
            close()
            out.append(line)
            mark = ""
        elif re.match(tx.BARE_ID, line):
            id_ = line.strip(".")
            last = re.split(structure.SENTENCE_END, paragraph)[-1] if re.search(f"[{tx.HEBREW}]", paragraph) else ""
            if title(id_, mark):
                close()
                out.append(f"{id_} {mark}")
                mark = ""
            elif last and title(id_, last):
                paragraph = " ".join(re.split(structure.SENTENCE_END, paragraph)[:-1])
                close()
                out.append(f"{id_} {last}")
            elif last and title(id_, paragraph):
                out.append(f"{id_} {paragraph}")
                paragraph = ""
            else:
                close()
                waiting = id_
        elif waiting:
            if title(waiting, line):
                out.append(f"{waiting} {line}")
            else:
                out.append(f"{waiting} Clause {waiting}")
                paragraph = line
            waiting = ""
        elif re.search(tx.JUNK_LINE, line):
            close()
        elif paragraph and line[0].islower() and re.fullmatch(r"[^\W\d_]{1,4}", paragraph.split()[-1]):
            paragraph += line
        elif paragraph and (line[0].islower() or len(line) < structure.WRAPPED_CHARS):
            paragraph += " " + line
        else:
            close()
            paragraph = line
    close()
    return out


def plain(spark, texts: list[str]) -> list[list[str]]:
    is_heading, is_title = Asked(), Asked()
    while True:
        found = [scanned(t, is_heading, is_title) for t in texts]
        if not (is_heading.open or is_title.open):
            return found
        for answers, rule in ((is_heading, lambda c: tx.heading(c).isNotNull()), (is_title, tx.title_like)):
            if answers.open:
                rows = spark.createDataFrame([(x,) for x in answers.open], "x string").select("x", rule(F.col("x")).alias("y")).collect()
                answers.update({r["x"]: r["y"] for r in rows})
                answers.open.clear()


def logical(spark, texts: list[str]) -> list[list[str]]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = [[] for _ in texts]
    for r in structure.reflowed(docs, "doc_id", F.col("text")).orderBy("doc_id", "line_no").collect():
        found[r["doc_id"]].append(r["line"])
    return found


def test_what_was_joined_decides(spark):
    found = logical(spark, ["the\nand\nwas going", "4.1\nAll rights reserved\nThe body of the clause, which has more than forty-eight code points.", "9.1\n\nMonitoring of it", "3.1\n3.2", ""])
    assert found[0] == ["theand was going"]
    assert found[1] == ["4.1 Clause 4.1", "All rights reserved", "The body of the clause, which has more than forty-eight code points."]
    assert found[2] == ["9.1 Clause 9.1", "Monitoring of it"] and found[3] == ["3.1", "3.2"] and found[4] == []


def test_equals_a_plain_scan(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    found = logical(spark, texts)
    for text, ours, theirs in zip(texts, found, plain(spark, texts), strict=True):
        assert ours == theirs, text


def test_documents_equal_a_plain_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").filter("text is not null").collect()
    texts = [r["text"].replace("\r\n", "\n").replace("\r", "\n") for r in rows]
    assert logical(spark, texts) == plain(spark, texts)


def test_a_paragraph_of_many_lines(spark):
    text = "\n".join(["Begins somewhere"] + ["goes on within lines"] * 20000)
    assert logical(spark, [text]) == [["Begins somewhere" + " goes on within lines" * 20000]]


def test_sections_keep_their_bodies(spark):
    docs = spark.createDataFrame([(1, "4 Context\nBody of four, which is told at some length here.\n4.1\nAll rights reserved by nobody\nBody of the first clause, which is told at some length.\n4.2 Needs\nBody of the second.")], "doc_id int, text string")
    found = {r["clause_id"]: r["body"] for r in sections.parse(docs).collect()}
    assert "first clause" in found["4.1"] and "second" in found["4.2"] and "first" not in found["4"]

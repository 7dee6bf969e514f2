"""Reading of tables, files, manifests and clause payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_type, edition, file_kind, file_language, file_standard
from .docx import docx_text

MANIFEST_BYTES = 16 << 20
PLAIN = ("txt", "md", "csv", "log", "yaml", "yml", "json")
SKIPPED = (".gitkeep", ".DS_Store")
CLAUSE = "clause_id string, title string, body string, text string, sort_order long"
SIDE = "struct<title:string, body:string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, kind, content of all files below a folder; placeholders are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(~F.col("name").isin(*SKIPPED))
    return found.select("path", "name", file_kind(F.col("name")).alias("kind"), "content")


def laid_out():
    """A column function: JSON with one value a line; other texts as they are."""

    def pretty(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            return text

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(pretty).astype(object)

    return read


def file_texts(found: DataFrame) -> DataFrame:
    """text and status of files(): `ok`, `parse-error` for word-processor files that can't be read, `binary` for kinds without a reader.

    Bad bytes are replaced; valid JSON is laid out with one value a line.
    """
    plain, docx = F.col("kind").isin(*PLAIN), F.col("kind") == "docx"
    text = F.make_valid_utf8(F.col("content").cast("string"))
    is_json = F.col("kind") == "json"
    text = F.when(is_json, laid_out()(F.when(is_json, text))).when(plain, text).when(docx, docx_text()(F.when(docx, F.col("content"))))
    status = F.when(docx & F.col("text").isNull(), "parse-error").when(plain | docx, "ok").otherwise("binary")
    return found.select("path", "name", "kind", text.alias("text")).withColumn("status", status)


def require(found: DataFrame, collections: DataFrame) -> None:
    """Raises if a collection that isn't optional has no file."""
    roots = collections.filter("not optional").select("id", "path").withColumnRenamed("path", "root")
    inside = F.contains(F.col("path"), F.concat(F.lit("/"), F.col("root"), F.lit("/")))
    empty = [r["id"] for r in roots.join(found.select("path"), inside, "left_anti").orderBy("id").collect()]  # a manifest's entries
    if empty:
        raise FileNotFoundError(f"collections without files: {', '.join(empty)}")


def blob(originals: DataFrame, id_: int | str, key: str = "id") -> DataFrame:
    """filename, content_type and file_data of one stored file."""
    return originals.filter(F.col(key) == id_).select("filename", content_type(F.col("filename")).alias("content_type"), "file_data")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, path, kind, optional, languages, standards, chunk_size, chunk_overlap of a YAML manifest's collections; missing settings get defaults.

    The manifest is one small file, read by Spark so that any file system will do.
    """
    import yaml

    raw = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path).collect())) or {}
    rows = []
    for c in raw.get("collections") or []:
        cut = c.get("ingest") or {}
        rows.append((c["id"], c.get("path"), c.get("kind"), bool(c.get("optional", False)), c.get("languages") or [], c.get("standards") or [], cut.get("chunk_size", 1000), cut.get("chunk_overlap", 100)))
    kind = "id string, path string, kind string, optional boolean, languages array<string>, standards array<string>, chunk_size int, chunk_overlap int"
    return spark.createDataFrame(rows, kind)


def seed_rows(texts: DataFrame, collections: DataFrame) -> DataFrame:
    """file_texts() with the collection each lies in and what its name tells: language, standard, edition."""
    roots = collections.select(F.col("id").alias("collection_id"), F.col("path").alias("root"), "languages", "standards", "chunk_size", "chunk_overlap")
    inside = F.contains(F.col("path"), F.concat(F.lit("/"), F.col("root"), F.lit("/")))
    size = roots.agg(F.sum(F.length("root") + 100)).first()[0] or 0
    if size > MANIFEST_BYTES:
        raise ValueError(f"a manifest of {size} bytes is too large to be sent to all tasks")
    rows = texts.filter("status = 'ok'").join(F.broadcast(roots), inside)
    name = F.col("name")
    return rows.select(
        "collection_id",
        F.col("path").alias("source_path"),
        "text",
        file_language(name, F.coalesce(F.get("languages", F.lit(0)), F.lit("en"))).alias("language"),
        file_standard(name, F.col("standards")).alias("standard"),
        edition(name).alias("edition"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        "chunk_size",
        "chunk_overlap",
    )


def clause_payloads(payloads: DataFrame, default: str) -> DataFrame:
    """standard, clause_id, title, body, sort_order of JSON texts: an array of clauses or {standard, clauses}; body falls back to text."""
    bare = F.from_json("payload", f"array<struct<{','.join(f.replace(' ', ':') for f in CLAUSE.split(', '))}>>")
    whole = F.from_json("payload", f"standard string, clauses array<struct<{','.join(f.replace(' ', ':') for f in CLAUSE.split(', '))}>>")
    is_array = F.startswith(F.ltrim("payload"), F.lit("["))
    rows = payloads.select(F.when(is_array, F.lit(None).cast("string")).otherwise(whole["standard"]).alias("standard"), F.explode(F.when(is_array, bare).otherwise(whole["clauses"])).alias("c"))
    return rows.select(F.coalesce("standard", F.lit(default)).alias("standard"), "c.clause_id", "c.title", F.coalesce("c.body", "c.text").alias("body"), "c.sort_order")


def is_bilingual(payload):
    """Whether the first item has a language side."""
    first = [F.get_json_object(payload, f"${p}[0].{side}") for p in ("", ".clauses") for side in ("en", "he")]
    return F.coalesce(*first).isNotNull()


def bilingual_payloads(payloads: DataFrame) -> DataFrame:
    """standard, language, clause_id, title, body, sort_order: a row for each side that a clause has."""
    item = f"struct<standard:string, clause_id:string, sort_order:long, en:{SIDE}, he:{SIDE}>"
    bare, whole = F.from_json("payload", f"array<{item}>"), F.from_json("payload", f"standard string, clauses array<{item}>")
    is_array = F.startswith(F.ltrim("payload"), F.lit("["))
    rows = payloads.select(F.when(~is_array, whole["standard"]).alias("standard"), F.explode(F.when(is_array, bare).otherwise(whole["clauses"])).alias("c"))
    sides = F.array(*[F.struct(F.lit(s).alias("language"), F.col(f"c.{s}.title").alias("title"), F.col(f"c.{s}.body").alias("body"), F.col(f"c.{s}").isNotNull().alias("has")) for s in ("en", "he")])
    rows = rows.select(F.coalesce("c.standard", "standard").alias("standard"), "c.clause_id", "c.sort_order", F.explode(F.filter(sides, lambda s: s["has"])).alias("s"))
    return rows.select("standard", "s.language", "clause_id", "s.title", "s.body", "sort_order")


def base64_payload(value):
    return F.try_to_binary(value, F.lit("base64"))

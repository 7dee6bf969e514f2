"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame that is written and read again as the next one's docs.

Defined cases: no rows give no rows, and of other columns than those of documents
none is passed on. Null texts go at the first stage, as do texts without letters
or between languages; where no row has a language to learn from, all texts with
letters stay. A text that lost all its lines is empty from then on and, like other
equal texts, stays once. Of rows that are equal in doc_id and text one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, language, linededup, neardup, packing
from corpusmill.llm.common import scratch_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those between two languages; without any labelled row only the former."""
    docs = docs.select(*COLUMNS)
    content = language.dictionaries(docs)
    if not content:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, content, COLUMNS)
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of all documents but the last that holds them."""
    kept = linededup.dedup_lines(docs, COLUMNS)
    kept = kept.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a benchmark's passages make up a twentieth of."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS, slop=None)
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", distinct_documents),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

ORACLE_SQL = None  # compression and tokenization can't be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

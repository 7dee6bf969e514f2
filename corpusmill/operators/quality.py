"""Samples, validation and body statistics of an indexed corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, key_bigrams
from ..storage import scratch

HIT_RATE, PHRASE_RATE = 0.8, 0.7
BUCKET = 10_000


def numbered(df: DataFrame, key: str, bucket: int = BUCKET) -> DataFrame:
    """Gapless `row` from 0 in order of a unique integer key.

    Buckets of keys are numbered from their counts, and those are added up in blocks of 4096, so no task sees more than a bucket
    of rows, or a row for 4096 buckets.
    """
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_bucket", F.floor(F.col(key) / bucket))
    counts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.shiftright("_bucket", 12))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n")).select("_block", upto(Window.orderBy("_block")).alias("_first"))
    starts = counts.join(blocks, "_block").select("_bucket", (F.col("_first") + upto(Window.partitionBy("_block").orderBy("_bucket"))).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return df.withColumn("_own", own).join(starts, "_bucket").withColumn("row", (F.col("_own") + F.col("_start")).cast("long")).drop("_bucket", "_own", "_start")


def ranked(df: DataFrame, order: list[Column], path: str) -> DataFrame:
    """Gapless `row` from 0 in any order: rows are sorted by range and written to `path`, and each range is numbered from the counts of those before it.

    Rows that are equal in `order` lie in one range; give it something that tells them apart.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    placed.write.parquet(path)
    placed = df.sparkSession.read.schema(placed.schema).parquet(path)
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_range").withColumn("row", own + F.col("_start")).drop("_at", "_range", "_start")


def systematic(df: DataFrame, key: str, size: int = 20) -> DataFrame:
    """Every n div size-th row by key, `size` of them at most."""
    step = max(1, df.count() // size)
    return numbered(df, key).filter((F.col("row") % step == 0) & (F.col("row") < step * size))


def sampled(docs: DataFrame, key: str, text: str, size: int = 20) -> DataFrame:
    """A systematic sample of the rows with a text. Keys alone are written and numbered; the texts are then read by the keys, which are `size` at most."""
    spark = docs.sparkSession
    with scratch(spark, "keys") as path:
        docs.filter(~blank(F.col(text))).select(key).write.parquet(path)
        keys = [r[key] for r in systematic(spark.read.parquet(path), key, size).select(key).collect()]
    return docs.filter(F.col(key).isin(keys))


def validate(sample: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """One row on an import: do the sampled sections have chunks, and do the chunks hold the sections' word pairs?"""
    said = chunks.join(F.broadcast(sample.select(key)), key, "left_semi").groupBy(key).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), " ")).alias("_said"))
    rows = sample.select(key, text).join(said, key, "left").withColumn("_pairs", key_bigrams(F.col(text)))
    found = F.when(F.col("_said").isNotNull(), F.size(F.filter("_pairs", lambda p: F.contains(F.col("_said"), p)))).otherwise(0)
    rows = rows.withColumn("_found", found).withColumn("_asked", F.when(F.col("_said").isNotNull(), F.size("_pairs")).otherwise(0))
    sums = rows.agg(F.count(F.lit(1)).alias("n_sampled"), F.count("_said").alias("n_found"), F.coalesce(F.sum("_asked"), F.lit(0)).alias("n_phrases"), F.coalesce(F.sum("_found"), F.lit(0)).alias("n_phrases_found"))
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 3)
    sums = sums.withColumn("rag_hit_rate", rate("n_found", "n_sampled")).withColumn("phrase_hit_rate", rate("n_phrases_found", "n_phrases"))
    return sums.withColumn("passed", (F.col("rag_hit_rate") >= HIT_RATE) & (F.col("phrase_hit_rate") >= PHRASE_RATE))


def body_counts(docs: DataFrame, by: list[str], body: Column) -> DataFrame:
    """n, and how many bodies are full (over 100 characters), partial or empty, with the whole percentage of full ones."""
    n = F.length(F.coalesce(body, F.lit("")))
    rows = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(n > 100).alias("n_full"), F.count_if((n > 0) & (n <= 100)).alias("n_partial"), F.count_if(n == 0).alias("n_empty"))
    return rows.withColumn("full_pct", F.expr("n_full * 100 div n"))

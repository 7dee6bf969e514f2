"""Scratch tables, size-checked broadcasts and row numbering shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches
from ..storage import scratch_path

#: A side is broadcast only when its measured bytes stay under this.
BROADCAST_BYTES = 16 << 20
#: Ways that the rows of a key are dealt in a lookup that is too large to broadcast.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and fixes the rows."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> int:
    """About the bytes of a table's rows. `df` should be a written table: it is read once here."""
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array"):
            width = width + 64 * F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0))
    return df.select(width.alias("w")).agg(F.sum("w")).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured size is under `limit`; else leave a shuffled join."""
    return F.broadcast(df) if measured(df) <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Spark goes by compressed bytes, of which words and hashes make tens of times as many on the driver."""
    return df.hint("merge")


def lookup(rows: DataFrame, known: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with a written table of one row a key, of which any may be held by a large share of rows.

    Broadcast if it is small; else each key is repeated SALTS times and the rows of a key are dealt among these.
    """
    if measured(known) <= limit:
        return rows.join(F.broadcast(known), keys, how)
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(shuffled(salted), [*keys, "_salt"], how).drop("_salt")


def text_key() -> list[Column]:
    """Names a documents row by content: doc_id (null: 0) and a hash of text and nullness."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull(), F.col("doc_id").isNull()).alias("_text"),
    ]

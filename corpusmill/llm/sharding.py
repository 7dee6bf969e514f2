"""Sharding by a keyed permutation of global row numbers.

Rows get gapless numbers 0..n-1, a Feistel network over Z_a x Z_b (a*b >= n,
a*b - n < a) permutes them, and cycle walking repeats the network where a
number leaves 0..n-1. Position p lies in shard p mod s at slot p div s, so both
can be computed for any row number and inverted, and shard sizes differ by one
row at most (law `rows`).

Defined cases: a null text counts 0 bytes and has the checksum of no bytes; null
and repeated doc_ids are numbered like others, ties ordered by checksum and size
(rows equal in all three are interchangeable: they are counted, numbered as one
and dealt out again in blocks); no rows give no rows; only doc_id
and text are read, so extra columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, written

SEED = 20240229
ROUNDS = 4
MASK = 0xFFFFFFFF
#: Rows of one key that are numbered together.
BLOCK_ROWS = 100_000


def halves(n: int) -> tuple[int, int]:
    """a and b of the smallest near-square domain a*b >= n with a*b - n < a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    keys = []
    for _ in range(rounds):
        seed = (seed * 1103515245 + 12345) & MASK
        keys.append(seed)
    return keys


def _mixed(x: Column, key: Column) -> Column:
    """A keyed 32-bit mix of x; every product stays under 2**63."""
    x = (x * F.lit(1103515245).cast("long") + key).bitwiseAND(F.lit(MASK))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = (x * F.lit(1566083941).cast("long")).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 15))


def feistel(number: Column, n: int, seed: int = SEED) -> Column:
    """One pass of the network: a bijection of 0..a*b-1. A fold, so the rounds stay one small expression."""
    a, b = (F.lit(x).cast("long") for x in halves(n))
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(round_keys(seed))])
    start = F.struct((number % a).alias("l"), ((number - number % a) / a).cast("long").alias("r"))
    step = lambda s, k: F.struct(
        F.when(k["left"], (s["l"] + _mixed(s["r"], k["key"])) % a).otherwise(s["l"]).alias("l"),
        F.when(k["left"], s["r"]).otherwise((s["r"] + _mixed(s["l"], k["key"])) % b).alias("r"),
    )
    return F.aggregate(keys, start, step, lambda s: s["r"] * a + s["l"])


def walk_length(spark: SparkSession, n: int, seed: int = SEED) -> int:
    """Further passes that bring every number of 0..n-1 back into the range.

    Exact: the at most a-1 numbers from n to a*b-1 are walked until none is outside.
    """
    a, b = halves(n)
    out, steps = spark.range(n, a * b).select(F.col("id").alias("x")), 0
    while not out.isEmpty():
        steps += 1
        out = written(out.select(feistel(F.col("x"), n, seed).alias("x")).filter(F.col("x") >= n), "walk")
    return steps


def permuted(number: Column, n: int, walks: int, seed: int = SEED) -> Column:
    """The place of a row number in the shuffled order 0..n-1, given walk_length's passes."""
    place = feistel(number, n, seed)
    if not walks:
        return place
    again = F.array_repeat(F.lit(0), walks)
    return F.aggregate(again, place, lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, seed)))


def numbered(keys: DataFrame, order: list[Column], bucket: Column) -> tuple[DataFrame, int]:
    """The first of the gapless numbers of each key's `n` rows, by (bucket, order), and the sum of n.

    Buckets are numbered from their sums, so no task sees more than a bucket of keys.
    """
    keys = keys.withColumn("_bucket", bucket)
    counts = written(keys.groupBy("_bucket").agg(F.sum("n").alias("_n")), "counts")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    total = starts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = keys.withColumn("_own", own).join(small(starts.drop("_n")), "_bucket")
    return keys.withColumn("first", F.col("_own") + F.col("_start")).drop("_own", "_start", "_bucket"), total


def unfolded(keys: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """`row`: a row for each of a key's numbers first .. first + n - 1. Keys of more than a block of rows are dealt by block before they become rows."""
    many = keys.filter(F.col("n") > block)
    parts = many.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    parts = parts.withColumn("first", F.col("first") + F.col("_at")).withColumn("n", F.least(F.lit(block).cast("long"), F.col("n") - F.col("_at"))).drop("_at")
    each = keys.filter(F.col("n") <= block).unionByName(parts.repartition("first"))
    return each.withColumn("row", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).drop("first", "n")


def shard(docs: DataFrame, shards: int = 40, seed: int = SEED, bucket_rows: int = 100_000, block: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, row, place, shard, slot of each row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    keys = written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "keys")  # equal rows are interchangeable
    buckets = max(1024, keys.count() // bucket_rows)
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets))
    keys, n = numbered(keys, [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size")], bucket)
    placed = unfolded(keys, block).withColumn("place", permuted(F.col("row"), max(1, n), walk_length(docs.sparkSession, n, seed) if n else 0, seed))
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row", "place")

"""Removal of lines that recur across documents, over levelled sorted runs.

A LineRuns store holds, by line key, in how many documents the line occurs and
the largest doc_id that holds it. It is a set of runs: Parquet tables of line
hashes that are bucketed and sorted. A new batch of documents is aggregated to
its own keys and merge-anti-joined with the runs: keys that no run has become a
run of the lowest level, the others raise the counts of those that have them. When
a level has `fanout` runs they are merged into one run of the next. After the last
batch every document's lines are looked up in the keys that recur, which are
broadcast if they are few and dealt with the lines of a hot key if not.

A line's key is the line without white space (space, tab to CR) at both ends and
with A-Z in lower case, held as two 64-bit hashes. Keys under `least_chars` code
points are never removed.

Defined cases: a null or empty text is one empty line; a null doc_id counts as a
document that is never the largest; rows that share a doc_id count as the
documents they are, and all of them hold the line if that doc_id is the largest;
lines that repeat inside a document count once for it and go or stay together;
no rows give no rows. Of other columns, those named by the caller are passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, scratch_path, table, text_key, written

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
BATCHES = 3
FANOUT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, n long, holder long"


def line_key(line: Column) -> Column:
    return F.translate(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def document_keys(least_chars: int = LEAST_CHARS) -> Column:
    """The distinct keys of a text that are long enough."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    return F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= least_chars))


class LineRuns:
    """Runs of line keys; `levels` names the tables of each level, newest last.

    A run is a table that is bucketed and sorted by key, so a batch meets it in a
    merge join that shuffles nothing of the run. No two runs share a key: what a
    batch tells about keys of older runs is kept in `raises`, which is small.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.folder, self.fanout = spark, folder or scratch_path(spark, "runs"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.raises: list[str] = []
        self.made: list[str] = []

    def _sorted(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        write = rows.write.option("path", f"{self.folder}/{name}").option("compression", "zstd")
        write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.made.append(name)
        return name

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _union(self, names: list[str]) -> DataFrame:
        every = self.spark.createDataFrame([], RUN) if not names else self.spark.table(names[0])
        for name in names[1:]:
            every = every.union(self.spark.table(name))
        return every

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys whose line is in no run."""
        for name in self.runs():
            keys = keys.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def ingest(self, keys: DataFrame) -> None:
        """Add a batch: h1, h2, holder rows, one a document and key."""
        own = self._sorted(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("holder").alias("holder")))
        if self.runs():
            batch, own = self.spark.table(own), self._sorted(self.unseen(self.spark.table(own)))
            self.raises.append(self._sorted(batch.join(self.spark.table(own).select("h1", "h2"), ["h1", "h2"], "left_anti")))
        self._push(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._push(self._sorted(self._union(names).repartition(self.buckets, "h1", "h2")), level + 1)
            level += 1

    def current(self) -> DataFrame:
        """All keys with their document count and largest holder."""
        more = self._union(self.raises).groupBy("h1", "h2").agg(F.sum("n").alias("_n"), F.max("holder").alias("_holder"))
        found = self.spark.createDataFrame([], RUN)
        for name in self.runs():
            raised = self.spark.table(name).join(more, ["h1", "h2"], "left")
            found = found.union(
                raised.select("h1", "h2", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("holder", "_holder").alias("holder"))
            )
        return found

    def close(self) -> None:
        """Takes the runs' tables out of the catalogue; their files stay in the store's folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made, self.levels, self.raises = [], [], []

    def recurring(self, least: int = LEAST_DOCUMENTS) -> DataFrame:
        return self.current().filter(F.col("n") >= least).select("h1", "h2", "holder")


def dedup_lines(docs: DataFrame, keep: list[str], batches: int = BATCHES, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Columns `keep` of docs, the text that stays, n_lines and n_dropped."""
    spark = docs.sparkSession
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key())
    lines = rows.select("_id", "_text", F.col("doc_id").alias("holder"), F.explode(document_keys(least_chars)).alias("k"))
    lines = lines.select("_id", "_text", "holder", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"), F.pmod(F.xxhash64("_id", "_text"), F.lit(batches)).cast("int").alias("batch"))
    path = scratch_path(spark, "lines")
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    kind = "_id long, _text long, holder long, h1 long, h2 long, batch int"
    lines = spark.read.schema(kind).parquet(path)
    runs = LineRuns(spark)
    try:
        for b in range(batches):
            runs.ingest(lines.filter(F.col("batch") == b).select("h1", "h2", "holder"))
        recurring = written(runs.recurring(least_documents).withColumnRenamed("holder", "largest"), "recurring")
    finally:
        runs.close()
    doomed = lookup(lines, recurring, ["h1", "h2"])
    doomed = doomed.filter(~F.coalesce(F.col("holder") == F.col("largest"), F.col("largest").isNull()))
    doomed = doomed.groupBy("_id", "_text").agg(F.collect_set("h1").alias("doomed"))
    joined = rows.join(doomed, ["_id", "_text"], "left")
    keyed = joined.withColumn("lines", lines_of(F.col("text")))
    gone = F.transform(F.transform("lines", line_key), lambda k: (F.char_length(k) >= least_chars) & F.array_contains("doomed", F.xxhash64(k)))
    keyed = keyed.withColumn("gone", F.when(F.col("doomed").isNotNull(), gone))
    stays = F.filter("lines", lambda _, i: ~F.element_at("gone", i + 1))
    return keyed.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("gone", lambda g: g)), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.holder AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

"""Importance resampling towards a target distribution.

Features are the runs of 1 to n consecutive words, joined by one space; a feature's
bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets. One scan of a
text keeps the running CRC states of the last starts: each word extends them by a
space and itself and begins a new one, so a run's bytes are never put together. The
scan emits each text's counted buckets, which are written once; totals, weights
and draws are taken from that table.

A bucket's gain is how much more frequent it is in the target than in the corpus
(a thousandth of a natural logarithm is the unit, every bucket has one more
occurrence). A text's weight is its mean gain, and its score that weight plus
Gumbel noise from a hash of its doc_id. The share of eligible texts of the largest
scores is a draw without replacement in proportion to the weights' exponentials.

Ranks: the score that the last drawn text can have is known from the counts of
scores, which are integers; texts from there on alone are range-sorted and numbered
by range.

Defined cases: null and empty texts have no features and weight 0; a null doc_id
hashes as the empty string and comes before others of its score; repeated rows
count repeatedly and are ranked one after the other; an empty corpus gives no rows
and an empty target gains from counts of 0. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .textkernel import chunks, text_buffer

GRAM, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Of a longer text, so many bytes are split into words at once.
PIECE_BYTES = 1 << 20
#: Marks that equal rows are dealt among.
MARKS = 1 << 20

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BREAKS = bytes(c for c in range(128) if not re.match(rb"[0-9A-Za-z]", bytes([c])))
_FOLD = bytes.maketrans(_UPPER + _BREAKS, _LOWER + b" " * len(_BREAKS))


class Ring:
    """The running CRC-32 of the runs of words that began last, n - 1 of them at most."""

    def __init__(self, n: int) -> None:
        self.n, self.states = n, []

    def take(self, words: Iterable[bytes]) -> list[int]:
        """The CRC-32 of every run that ends at one of these words, the longest first."""
        out, states, keep = [], self.states, self.n - 1
        for word in words:
            if states:
                spaced = b" " + word
                states = [crc32(spaced, s) for s in states]
            states.append(crc32(word))
            out += states
            states = states[-keep:] if keep else []
        self.states = states
        return out


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece: A to Z in lower case, all but letters, digits and bytes from 128 on break."""
    folded, first = text.translate(_FOLD), 0
    while first < len(folded):
        last = len(folded) if len(folded) - first <= size else folded.find(b" ", first + size)
        last = len(folded) if last < 0 else last
        yield folded[first:last].split()
        first = last


def counted(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words, the distinct buckets of a text's features, and how often each occurs."""
    ring, words, found, times = Ring(n), 0, [], []
    for piece in pieces(text):
        words += len(piece)
        each, count = np.unique(np.array(ring.take(piece), np.int64) % buckets, return_counts=True)
        found.append(each)
        times.append(count)
    if len(found) == 1:
        return words, found[0], times[0]
    if not found:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    each, place = np.unique(np.concatenate(found), return_inverse=True)
    return words, each, np.bincount(place, np.concatenate(times), len(each)).astype(np.int64)


def _emitted(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        for first, last in chunks(at):
            rows = [counted(raw[at[i] : at[i + 1]].tobytes(), n, buckets) for i in range(first, last)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]), kind)) for i, kind in ((1, pa.int32()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array([r[0] for r in rows], pa.int64()), *lists], names=["doc_id", "n_words", "buckets", "times"])


def emitted(docs: DataFrame, n: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, buckets, times: one scan of each text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _emitted(b, n, buckets), "doc_id long, n_words long, buckets array<int>, times array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, times, and the place where each row's begin."""
    each, times = batch.column("buckets"), batch.column("times")
    at = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return each.flatten().to_numpy(), times.flatten().to_numpy(), at


def totals(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all rows; each task adds its own first."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            each, times, _ = _flat(batch)
            n += np.bincount(each, times, buckets).astype(np.int64)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "n": pa.array(n[held])})

    return scanned.select("buckets", "times").mapInArrow(summed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, from the two totals, which are a row a bucket at most."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, rows in ((s, source), (t, target)):
        for row in rows.collect():
            side[row["bucket"]] = row["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each, times, at = _flat(batch)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        n, total = sums(times), sums(gain[each] * times)
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64())})


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rank from 1 in an order, range by range; equal rows have marks, so that they too lie in several ranges."""
    marked = written(rows.withColumn("_mark", F.pmod(F.monotonically_increasing_id() * 40503, F.lit(MARKS))), "marked")
    order = [*order, F.col("_mark")]
    sorted_ = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(sorted_.withColumn("_part", F.shiftright("_at", 33)).drop("_mark"), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", own + F.col("_start") + 1).drop("_at", "_part", "_start")


def resample(docs: DataFrame, target: DataFrame, n: int = GRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of all docs, and the rank of those drawn."""
    scanned = written(emitted(docs, n, buckets), "emitted")
    aimed = emitted(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets)
    gain = gains(totals(scanned, buckets), totals(aimed, buckets), buckets)
    weighed = scanned.mapInArrow(lambda b: _weighed(b, gain), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = F.col("n_words") >= least_words
    counts = written(scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    size = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # a row a distinct score
    least = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter(F.col("before") < size).agg(F.min("score")).first()[0]
    drawn = able & (F.col("score") >= F.lit(least)) if size else F.lit(False)
    ranked = numbered(scored.filter(drawn), [F.desc("score"), F.asc_nulls_first("doc_id")])
    rank = F.when(F.col("rank") <= size, F.col("rank")).cast("long").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_crc_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the table of the polynomial by a recursive query, then a fold over the bytes of a string.
CRC_TABLE = """
steps AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


def crc_sql(s: str) -> str:
    """The CRC-32 of a string column, where the table `crc` is joined."""
    value = f"list_transform(range(0, octet_length(encode({s}))), lambda i: ('0x' || hex(encode({s}))[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {value}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS s FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS s FROM d),
v AS (SELECT s, {crc_sql("s")} % 10000 AS bucket FROM (SELECT s FROM f UNION SELECT s FROM b), crc),
sb AS (SELECT bucket, count(*) AS n FROM f JOIN v USING (s) GROUP BY bucket),
tb AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (s) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(tb.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM sb)::DOUBLE + 10000)
      / ((coalesce(sb.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM tb)::DOUBLE + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN sb USING (bucket) LEFT JOIN tb USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN v USING (s) JOIN g USING (bucket) GROUP BY doc_id),
x AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""

"""Quality classifier: hashed subword embeddings, averaged per document, with a softmax output.

Features of a text are its words, its pairs of neighbouring words (two equal words are
one pair, whatever they are) and its character n-grams of 2 to 4 code points, in which white
space stands at either end alone. Each is hashed to one of `buckets` learned vectors. A
document is the mean of its features' vectors, and its score the softmax of a
linear map of that mean.

Training is stochastic gradient descent in numpy, on a bounded sample: of each label's
training rows, the one of the smallest hash in each of `slots` hash slots, so both
labels weigh alike. Features of the sample are counted once and written. In each epoch `parts`
tasks start from the same weights, each goes through its own part of the sample row by
row, and their weights are averaged (local descent); what goes to the driver is `parts` weight
arrays.

Between the mean and the softmax nothing is bent, so for scoring each bucket's vector
becomes one number, and a text costs a lookup for each of its features.

Defined cases: null and empty texts have no features and score 0.5; a text of more than
2 MB is read in pieces of that size that end at white space, and no n-gram lies in two of them; rows
of a null doc_id, text or label aren't learned from; where a doc_id has both labels, 0
counts, and of several texts of a doc_id the one of the smallest hash is learned from; without
training rows everything scores 0.5; repeated rows get equal scores. Only doc_id and text are
read, and of labels doc_id and quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .textkernel import CHUNK_BYTES, SEPARATOR, Powers, Words, chunks, mix, text_buffer, windows

BUCKETS, SIZE = 1 << 16, 8
SHORTEST, LONGEST = 2, 4
#: The bound of the training sample: rows of each label.
SLOTS = 3000
PARTS, EPOCHS, RATE, SEED = 4, 6, 0.5, 13
HELD_OUT, KEPT_FROM = 5, 0.3

_SAME = np.uint64(0x5851F42D4C957F2D)


def held_out() -> Column:
    """One fifth of the documents, never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(False))


def pieces(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows of about CHUNK_BYTES; a longer row comes in several."""
    for first, last in chunks(at):
        if last - first > 1 or at[last] - at[first] <= CHUNK_BYTES:
            yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
            continue
        begin = at[first]
        while begin < at[last]:
            end = min(at[last], begin + CHUNK_BYTES)
            if end < at[last]:
                gaps = np.flatnonzero(SEPARATOR[raw[begin:end]])
                letters = np.flatnonzero((raw[begin:end] & 0xC0) != 0x80)  # a word without end is cut between code points
                end = begin + (gaps[-1] + 1 if len(gaps) else letters[-1] if letters[-1] else end - begin)
            yield first, raw[begin:end], np.array([0, end - begin])
            begin = end


def features(raw: np.ndarray, at: np.ndarray, tables: Powers, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows of words, of pairs of words, and of character n-grams of each length."""
    mask = np.uint64(buckets - 1)
    words = Words(raw, at, 0, len(at) - 1, tables, fold=False)
    hashes = words.hashes()
    yield (hashes & mask).astype(np.int64), words.row
    pair, first = windows(hashes, words.row, 2)
    pair = np.where(hashes[first] == hashes[first + 1], _SAME, pair)
    yield (pair & mask).astype(np.int64), words.row[first]
    letters = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(starts))
    gap = (letters == 32) | ((letters >= 9) & (letters <= 13))
    code = np.where(gap, np.uint64(32), letters)
    open_ = np.ones(len(code), bool)  # no white space inside
    total = code
    for n in range(2, LONGEST + 1):
        if len(code) < n:
            return
        if n > 2:
            open_ = open_[:-1] & ~gap[n - 2 : len(gap) - 1]
        else:
            open_ = open_[:-1]
        total = total[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n >= SHORTEST:
            good = open_ & (row[: len(open_)] == row[n - 1 :]) & ~(gap[: len(open_)] & gap[n - 1 :])
            yield (mix(total[good] + np.uint64(n)) & mask).astype(np.int64), row[: len(open_)][good]


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The counted buckets of each row."""
    tables = Powers()
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for first, own, ends in pieces(raw, at):
            yield from _given(batch, held, [i for i in held if i < first])
            for bucket, row in features(own, ends, tables, buckets):
                key, n = np.unique(row.astype(np.int64) * buckets + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(len(ends)) * buckets)
                for i in range(len(ends) - 1):
                    held.setdefault(first + i, []).append((key[cut[i] : cut[i + 1]] % buckets, n[cut[i] : cut[i + 1]]))
        yield from _given(batch, held, list(held))


def _given(batch: pa.RecordBatch, held: dict[int, list[tuple[np.ndarray, np.ndarray]]], rows: list[int]) -> Iterator[pa.RecordBatch]:
    for i in rows:
        bucket, n = (np.concatenate(x) for x in zip(*held.pop(i), strict=True))
        bucket, place = np.unique(bucket, return_inverse=True)
        lists = {"buckets": pa.array([bucket.astype(np.int32)], pa.list_(pa.int32())), "times": pa.array([np.bincount(place, n, len(bucket)).astype(np.int32)], pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(i, 1) for c in ("part", "h", "label")} | lists)


def sample(docs: DataFrame, labels: DataFrame, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """part, h, label, text: at most `slots` rows of each label."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    picked = known.groupBy("label", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min(F.struct("h", "doc_id")).alias("b"))
    picked = written(picked.select("label", "b.h", "b.doc_id"), "picked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(picked), "doc_id")  # 2 * slots rows at most
    one = texts.groupBy("doc_id", "label", "h").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("b"))
    return one.select(F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"), "h", "label", "b.text")


def descended(vectors: np.ndarray, output: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], rate: float) -> None:
    """One pass over rows of (label, buckets, shares), in place."""
    for label, bucket, share in rows:
        own = vectors[bucket]
        mean = share @ own
        z = output @ mean
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        back = p @ output
        output -= rate * np.outer(p, mean)
        # features of a document share its gradient by their counts; its scale is kept by the number of features that differ
        vectors[bucket] = own - (rate * np.sqrt(len(bucket)) * share)[:, None] * back


def begun(buckets: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.uniform(-1 / size, 1 / size, (buckets, size)).astype(np.float32), draw.uniform(-1, 1, (2, size)).astype(np.float32)


def _epoch(group: pa.Table, weights: tuple[np.ndarray, np.ndarray], rate: float, turn: int) -> pa.Table:
    vectors, output = weights[0].copy(), weights[1].copy()
    order = np.argsort(mix(group.column("h").to_numpy().view(np.uint64) + np.uint64(turn)))
    group = group.take(pa.array(order))
    rows = []
    for label, bucket, times in zip(group.column("label").to_pylist(), group.column("buckets"), group.column("times"), strict=True):
        n = times.values.to_numpy().astype(np.float32)
        rows.append((label, bucket.values.to_numpy(), n / n.sum()))
    descended(vectors, output, rows, rate)
    return pa.table({"n": [len(rows)], "vectors": [vectors.tobytes()], "output": [output.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, slots: int = SLOTS, parts: int = PARTS, epochs: int = EPOCHS, rate: float = RATE, buckets: int = BUCKETS, size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and the output map."""
    told = sample(docs, labels, slots, parts).mapInArrow(lambda b: _counted(b, buckets), "part int, h long, label int, buckets array<int>, times array<int>")
    told = written(told.filter("size(buckets) > 0"), "features")
    weights = begun(buckets, size, seed)
    for turn in range(epochs):
        now, step = weights, rate * (1 - turn / epochs)
        found = told.groupBy("part").applyInArrow(lambda g: _epoch(g, now, step, turn), "n long, vectors binary, output binary").collect()  # noqa: B023  # `parts` rows
        if not found:
            break
        share = np.array([r["n"] for r in found], np.float64)
        share /= share.sum()
        mean = lambda name, like: sum(w * np.frombuffer(bytes(r[name]), np.float32) for w, r in zip(share, found, strict=True)).astype(np.float32).reshape(like.shape)  # noqa: B023, E731
        weights = mean("vectors", now[0]), mean("output", now[1])
    return weights if found else (weights[0] * 0, weights[1])


def _scored(batches: Iterator[pa.RecordBatch], worth: np.ndarray) -> Iterator[pa.RecordBatch]:
    tables = Powers()
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        total, n = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for first, own, ends in pieces(raw, at):
            for bucket, row in features(own, ends, tables, len(worth)):
                total[first : first + len(ends) - 1] += np.bincount(row, worth[bucket], len(ends) - 1)
                n[first : first + len(ends) - 1] += np.bincount(row, minlength=len(ends) - 1)
        score = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1), -500, 500)))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score)})


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score: the softmax's share of label 1."""
    worth = (weights[0] @ (weights[1][1] - weights[1][0])).astype(np.float64)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scored(b, worth), "doc_id long, score double")


def op13_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEPT_FROM).cast("int").alias("predicted"))

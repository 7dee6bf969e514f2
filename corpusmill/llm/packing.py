"""Packing of documents into fixed-length sequences along a Hilbert curve.

Each document is encoded once; the hashed vectors of its words, averaged (marks
set off from them don't count), are a projection to three dimensions, and the
Hilbert key of that point orders the corpus so that similar documents are
neighbours. The ordered documents' ids are one stream that is cut every `capacity`
ids, so only the last sequence has padding.

The order is by range of (Hilbert key, doc_id, content), in ranges of about
`RANGE_BYTES` of ids (up to MOST_RANGES of them), so a key that many documents
share is many ranges. Each range counts its ids as it is written, the ranges' sums
are added up in order, and then every document can be cut on its own.

Words are encoded once and kept: white space never joins two pieces of this
tokenizer's pattern, nor do a letter and a mark beside it, so a text's ids are the
ids of its words and marks in order. Tested against encoding of whole texts.

Defined cases: null and empty texts give the end id alone; repeated rows are
packed as often as they occur; ties on the curve are ordered by doc_id, then by
content; no rows give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import trimmed
from .common import small, table, written
from .textkernel import SEPARATOR, chunks, mix, text_buffer

CAPACITY = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 10
RANGE_BYTES = 8 << 20
#: Beyond as many ranges they grow instead: half a GB of ids each at 50 TB of ids.
MOST_RANGES = 100_000
#: Marks that rows of one key, doc_id and content are dealt by.
SALTS = 64
CACHED_WORDS = 500_000
#: ASCII marks other than apostrophes, which begin pieces such as 's.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARK = np.zeros(256, bool)
MARK[list(MARKS)] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
#: First bytes of U+00C0 to U+023F, all letters but two (U+00D7 and U+00F7); the lower case of U+0130 ends with a mark.
LEAD = np.zeros(256, bool)
LEAD[0xC3:0xC9] = True
LETTERS_A_CALL = 200
#: Texts that are encoded whole: case folding would make or break a special token, or a capital's composition with accents.
ODD = r"<\||[HIJTWY]\p{M}"


def worker_store() -> dict:
    """Lives as long as the Python worker, across tasks."""
    name = "_corpusmill_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__.setdefault("kept", {})


class Grown:
    """An array that takes rows at its end."""

    def __init__(self, like: np.ndarray) -> None:
        self.data, self.size = np.zeros((1024, *like.shape[1:]), like.dtype), 0

    def add(self, rows: np.ndarray) -> None:
        while self.size + len(rows) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size : self.size + len(rows)] = rows
        self.size += len(rows)

    def now(self) -> np.ndarray:
        return self.data[: self.size]


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start..start+length-1 of each pair, in a row."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What lies between spaces, between a letter and a mark beside it, and in one of the texts at..at; and the text of each."""
    n = len(raw)
    if not n:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    solid, mark = ~SEPARATOR[raw], MARK[raw]
    begin = np.ones(n, bool)
    begin[1:] = ~solid[:-1]
    begin[at[:-1][at[:-1] < n]] = True
    lead = LEAD[raw]
    lead[:-1] &= ~(((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))) | ((raw[:-1] == 0xC4) & (raw[1:] == 0xB0)))
    letter = LETTER[raw]
    last = letter.copy()
    last[1:] |= lead[:-1]
    begin[1:] |= (mark[:-1] & (letter | lead)[1:]) | (last[:-1] & mark[1:])
    start = np.flatnonzero(begin & solid)
    kept = np.concatenate([[0], np.cumsum(solid)])
    ends = np.append(kept[start], kept[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw[solid])])
    return words, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))


class WordEncoder:
    """Ids and hashed vectors of words and marks, each encoded once until the cache is full."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.flat, self.start, self.length = Grown(np.zeros(0, np.uint16)), Grown(np.zeros(0, np.int64)), Grown(np.zeros(0, np.int64))
        self.vector, self.counts = Grown(np.zeros((0, DIMENSIONS), np.float32)), Grown(np.zeros(0, bool))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def learn(self, words: list[bytes]) -> None:
        """Takes words in that aren't known: ASCII letters are a piece that needs the model alone, other letters go in few calls, the rest one by one."""
        plain, letters, rest = [], [], []
        for word, text in zip(words, b" ".join(words).decode("utf-8", "replace").split(" "), strict=True):
            if not text.isalpha():
                rest.append(word)
            elif text.isascii():
                plain.append(word)
            else:
                (letters if text.lower() == text and is_normalized("NFC", text) else rest).append(word)
        tokenize = self.tokenizer.model.tokenize
        self._put_each(plain, [[t.id for t in tokenize(w.decode())] for w in plain])
        for first in range(0, len(letters), LETTERS_A_CALL):
            some = letters[first : first + LETTERS_A_CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint16)
            length = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(length) == len(some):
                self._put(some, ids, length)
            else:
                rest += some
        self._put_each(rest, [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)])

    def _put_each(self, words: list[bytes], each: list[list[int]]) -> None:
        if words:
            self._put(words, np.array([i for ids in each for i in ids], np.uint16), np.array([len(ids) for ids in each], np.int64))

    def _put(self, words: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        self.codes.update(zip(words, range(self.start.size, self.start.size + len(words)), strict=True))
        own = np.cumsum(length) - length
        # a word's vector is a hash of its ids, not of its place in the cache
        order = (np.arange(len(ids)) - np.repeat(own, length)).astype(np.uint64)
        total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * (np.uint64(1) + np.uint64(2) * order), out=total[1:])
        name = mix(total[own + length] - total[own])
        counts = np.fromiter((w.translate(None, MARKS) != b"" for w in words), bool, len(words))
        hashed = np.stack([(mix(name + np.uint64(d + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 - 0.5 for d in range(DIMENSIONS)], axis=1)
        self.vector.add(hashed * counts[:, None])
        self.counts.add(counts)
        self.start.add(own + self.flat.size)
        self.length.add(length)
        self.flat.add(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ids per text, mean vector per text; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, ODD)
        raw, at = text_buffer(pc.ascii_lower(pc.if_else(odd, "", texts)))
        words, text = _words(raw[at[0] : at[-1]], at - at[0])
        words = words.dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), b" ")[0].as_buffer().to_pybytes().split()
        new = [w for w in names if w not in self.codes]
        if len(self.codes) + len(new) > CACHED_WORDS:
            self.clear()
            new = names
        if new:
            self.learn(new)
        code = np.fromiter(map(self.codes.__getitem__, names), np.int64, len(names))[words.indices.to_numpy()]
        size = self.length.now()[code]
        ids = self.flat.now()[spans(self.start.now()[code], size)]
        count = np.bincount(text, size, len(texts)).astype(np.int64)
        vector, counts = self.vector.now(), self.counts.now()[code]
        per_text = np.bincount(text, counts, len(texts))
        mean = np.stack([np.bincount(text, vector[code, d], len(texts)) for d in range(DIMENSIONS)], axis=1) / np.maximum(1, per_text)[:, None]
        if pc.any(odd).as_py():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                parts[i] = self.whole(texts[i].as_py())
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, count, mean


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of integer points (rows) on the Hilbert curve of 2**bits steps a side, by axes transposition."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(mean: np.ndarray) -> np.ndarray:
    """Squashes the vectors to the unit cube (a word's spread is 0.29 a dimension) and returns Hilbert keys."""
    unit = 0.5 + 0.5 * np.tanh(6 * mean)
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    trimmed()
    store = worker_store()
    if path not in store:
        store[path] = WordEncoder(path)
    encoder = store[path]
    given = 0
    for batch in batches:
        _, at = text_buffer(batch.column("text"))
        for first, last in chunks(at, 1 << 20):
            ids, count, mean = encoder.encode(batch.column("text").slice(first, last - first))
            ends = np.concatenate([[0], np.cumsum(count)])
            whole = [np.append(ids[i:j], np.uint16(END_ID)) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "curve": pa.array(curve_keys(mean)),
                    "n": pa.array(count + 1),
                    "content": pa.array(np.array([zlib.crc32(x.tobytes()) for x in whole], np.int64)),
                    "salt": pa.array((given + np.arange(last - first)) % SALTS),
                    "ids": pa.array([x.tobytes() for x in whole], pa.binary()),
                }
            )
            given += last - first
    trimmed()


ORDERED = "range long, before long, doc_id long, curve long, n long, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, with its number and the ids before each in it."""
    from pyspark import TaskContext

    number, filled = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = filled + np.cumsum(n)
        kept = {c: batch.column(c) for c in ("doc_id", "curve", "n", "ids")}
        yield pa.RecordBatch.from_pydict({"range": pa.array(np.full(len(n), number, np.int64)), "before": pa.array(ends - n), **kept})
        filled = int(ends[-1]) if len(n) else filled


def _cut(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of rows; `at` is the stream's offset of the row's first id."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("at", "doc_id", "n", "curve")]
        for at, doc, n, curve, ids in zip(*columns, batch.column("ids"), strict=True):
            start = 0
            own = np.frombuffer(ids.as_buffer(), np.uint16).astype("<u4")
            while start < n:
                length = min(n - start, capacity - (at + start) % capacity)
                rows.append((doc, start, length, zlib.crc32(own[start : start + length]), n, (at + start) // capacity, (at + start) % capacity, curve))
                start += length
        if rows:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*rows, strict=True), strict=True)})


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = rows.mapInArrow(lambda b: _encoded(b, path), "doc_id long, curve long, n long, content long, salt long, ids binary")
    coded = written(coded, "encoded")
    total = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(spark.sparkContext.defaultParallelism, min(MOST_RANGES, -(-2 * total // range_bytes)))
    order = ["curve", "doc_id", "content", "salt"]
    ordered = coded.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = written(ordered.mapInArrow(_counted, ORDERED), "ordered")
    sums = written(ordered.groupBy("range").agg(F.sum("n").alias("n")).withColumn("block", F.shiftright("range", 12)), "sums")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))  # a row for 4096 ranges
    blocks = blocks.select("block", upto(Window.orderBy("block")).alias("first"))
    bases = sums.join(small(written(blocks, "blocks")), "block")
    bases = written(bases.select("range", (F.col("first") + upto(Window.partitionBy("block").orderBy("range"))).alias("base")), "bases")
    placed = ordered.join(small(bases), "range").select((F.col("base") + F.col("before")).alias("at"), "doc_id", "n", "curve", "ids")
    return placed.mapInArrow(lambda b: _cut(b, capacity), PIECE)


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Quality rules with an n-gram perplexity band per language.

Text counts (words, symbols, repeated lines, words of repeated 8-word windows)
decide the base rules. On top, a modified Kneser-Ney model of each language is
counted by Spark over all documents: 4-grams of characters (UTF-16 units, lower
case, digits alike, white space alike), so any script is modelled letter by
letter. Four units of 16 bits are one long, contexts and suffixes are shifts and
masks of it, and the model is a table that is made by grouping and joining: a
row for each n-gram of each order with its log probability and its back-off as a
context. It grows with the corpus's distinct n-grams.

The model is stored as arrays sorted by n-gram hash. Where these are at most
`MODEL_BYTES` (measured), all tasks get them and find a hash by its first bits and
a short probe. Where they are more, each text's counted n-grams are joined with
the model's table instead, hot n-grams dealt over salts.

Every document gets its mean bits a character and a word under its language's
model. Each measure has a band around the middle of the language's quartiles, over
all its documents: width * sqrt(iqr**2 + spread**2 / length), since short texts
vary more. Documents outside either band are rejected: upwards garbled, downwards
repetitive.

Defined cases: a null or empty text has no words and fails the base rules; a
null lang is a language of its own; a text under four characters has no
perplexity (null) and is judged by the base rules alone; repeated rows count
repeatedly; no rows give no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, small, table, written
from .textkernel import SEPARATOR, Powers, Words, chunks, mix, text_buffer, windows

ORDER, UNIT_BITS = 4, 16
WINDOW_WORDS = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: In steps of 0.25 the least that rejects at most 1 % of the documents of sf0.1 that are labelled good and pass the base rules.
WIDTH = 1.75
#: Bits that a character's and a word's share vary by; of 0, 5, 10 ... and 0, 0.5, 1 ... those under which WIDTH rejects most of the labelled bad ones.
SPREAD, WORD_SPREAD = 2.0, 10.0
#: Of the sorted arrays, 16 bytes an n-gram.
MODEL_BYTES = 48 << 20
#: N-grams that a task holds before it merges their counts.
HELD_GRAMS = 1 << 22

LINE_END = np.zeros(256, bool)
LINE_END[0x0A] = True
MARKED = np.zeros(256, bool)
MARKED[list(b"#*$%&|<>")] = True

FOLD = np.arange(1 << UNIT_BITS, dtype=np.uint64)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[[9, 10, 11, 12, 13]] = 32


def units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded UTF-16 units of UTF-8 texts, and each text's offsets into them."""
    found = FOLD[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), np.uint16)]
    size = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80).astype(np.int64) + (raw >= 0xF0))])
    return found, size[at]


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of texts, and each one's text; none spans two texts."""
    s, at = units(raw, at)
    n = len(s) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for j in range(ORDER):
        code = (code << np.uint64(UNIT_BITS)) | s[j : j + n]
    per_row = np.maximum(0, np.diff(at) - ORDER + 1)
    row = np.repeat(np.arange(len(at) - 1), per_row)
    place = np.repeat(at[:-1], per_row) + np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return code[place], row


def tallied(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their sums of n."""
    if n is None:
        return np.unique(code, return_counts=True)
    found, inverse = np.unique(code, return_inverse=True)
    return found, np.bincount(inverse, n, len(found)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            code, n = tallied(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(code), pa.string()), "code": pa.array(code.view(np.int64)), "n": pa.array(n)})
        held.clear()

    for batch in batches:
        names = batch.column("lang").to_pylist()
        for lang in dict.fromkeys(names):
            own = batch.filter(pa.array([x == lang for x in names]))
            raw, at = text_buffer(own.column("text"))
            for first, last in chunks(at):
                code, n = tallied(grams(raw[at[first] : at[last]], at[first : last + 1] - at[first])[0])
                held.setdefault(lang, []).append((code, n))
                size += len(code)
                if size > HELD_GRAMS:
                    for name, parts in held.items():
                        held[name] = [tallied(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    size = sum(len(p[0]) for parts in held.values() for p in parts)
                    if size > HELD_GRAMS // 2:
                        yield from given()
                        size = 0
    yield from given()


def language_key(lang: Column) -> Column:
    """A language's name for grouping and joining; null has one of its own."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))


def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << UNIT_BITS * (order - 1)) - 1).cast("long"))


def _prefix(code: Column) -> Column:
    return F.shiftrightunsigned(code, UNIT_BITS)


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney from counts of counts; 0.5, 1, 1.5 where those are missing."""
    of = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    n = level.groupBy("lang").agg(*of)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = lambda i: F.when(known, F.least(F.lit(float(i)), F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(0.5 * i)
    return n.select("lang", *[d(i).alias(f"d{i}") for i in (1, 2, 3)])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, ord, code, logp, back of all n-grams of orders 1 to 4, from the counts (lang, code, n) of 4-grams.

    Lower orders count how many n-grams of the next order end in them. Order 0 holds each language's uniform probability.
    """
    levels = {ORDER: counts.select("lang", "code", F.col("n").alias("c"))}
    for order in range(ORDER - 1, 0, -1):
        above = levels[order + 1].groupBy("lang", _suffix(F.col("code"), order + 1).alias("code")).agg(F.count(F.lit(1)).alias("c"))
        levels[order] = written(above, f"grams{order}")
    uniform = levels[1].groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("p"))
    lower = written(uniform.select("lang", F.lit(0).cast("long").alias("code"), "p"), "uniform")
    found = [lower.select("lang", F.lit(0).alias("ord"), "code", "p", F.lit(None).cast("double").alias("spare"))]
    for order in range(1, ORDER + 1):
        level = levels[order].withColumn("context", _prefix(F.col("code")))
        rows = level.join(F.broadcast(_discounts(level)), "lang")  # a row a language
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("spare"))
        contexts = written(contexts, f"contexts{order}")
        rows = rows.join(contexts, ["lang", "context"]).withColumn("suffix", _suffix(F.col("code"), order) if order > 1 else F.lit(0).cast("long"))
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("spare") * F.col("lp")
        rows = rows.join(lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("lp")), ["lang", "suffix"]).select("lang", "code", p.alias("p"))
        lower = written(rows, f"level{order}")
        # what this order's contexts, which are n-grams of the order below, spare for it
        below = found.pop().drop("spare").join(contexts.select("lang", F.col("context").alias("code"), "spare"), ["lang", "code"], "left")
        found += [below, lower.select("lang", F.lit(order).alias("ord"), "code", "p", F.lit(None).cast("double").alias("spare"))]
    every = found[0].select("lang", "ord", "code", "p", "spare")
    for level in found[1:]:
        every = every.unionByName(level.select("lang", "ord", "code", "p", "spare"))
    log = lambda c: F.log2(F.greatest(c, F.lit(1e-12)))
    return every.select("lang", "ord", "code", log(F.col("p")).cast("float").alias("logp"), F.coalesce(log(F.col("spare")), F.lit(0.0)).cast("float").alias("back"))


def hashed(code: np.ndarray, order: int) -> np.ndarray:
    return mix(code + np.uint64(order * 0x9E3779B97F4A7C15 % 2**64))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of each language, sorted by n-gram hash."""
    for batch in batches:
        names, order = np.array(batch.column("lang").to_pylist(), object), batch.column("ord").to_numpy()
        code = batch.column("code").to_numpy().view(np.uint64)
        key = mix(code + order.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        logp, back = batch.column("logp").to_numpy(), batch.column("back").to_numpy()
        for lang in dict.fromkeys(names):
            own = np.flatnonzero(names == lang)
            own = own[np.argsort(key[own])]
            yield pa.RecordBatch.from_pydict({"lang": [lang], "hashes": [key[own].tobytes()], "logp": [logp[own].tobytes()], "back": [back[own].tobytes()]})


class Sorted:
    """A language's n-grams by sorted hash, with the place where each leading bit pattern begins."""

    def __init__(self, parts: list[tuple[bytes, bytes, bytes]]) -> None:
        hashes, logp, back = (np.concatenate([np.frombuffer(x, kind) for x in own]) for own, kind in zip(zip(*parts, strict=True), (np.uint64, np.float32, np.float32), strict=True))
        order = np.argsort(hashes)
        self.hashes, self.logp, self.back = np.append(hashes[order], np.uint64(2**64 - 1)), np.append(logp[order], np.float32(0)), np.append(back[order], np.float32(0))
        bits = max(1, int(len(order)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(hashes[order], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that aren't there."""
        at = self.first[hashes >> self.shift]
        seen = self.hashes[at]
        open_ = np.flatnonzero(seen < hashes)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.hashes[at[open_]] < hashes[open_]]
        return np.where(self.hashes[at] == hashes, at, -1)

    def score(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 probability of n-grams: their own, or the next lower order's plus what their context spares."""
        at = self.find(hashed(code, order))
        out = self.logp[at]
        missing = np.flatnonzero(at < 0)
        if len(missing) and order == 0:
            out[missing] = 0.0
        elif len(missing):
            own = code[missing]
            rest = self.score(own & np.uint64((1 << UNIT_BITS * (order - 1)) - 1), order - 1)
            context = self.find(hashed(own >> np.uint64(UNIT_BITS), order - 1))
            out[missing] = rest + np.where(context >= 0, self.back[context], np.float32(0))
        return out


def models(docs: DataFrame) -> DataFrame:
    """The model's table, counted over all documents (lang, text)."""
    counted = docs.mapInArrow(_counted, "lang string, code long, n long")
    counted = written(counted.groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams4")
    return written(kneser_ney(counted), "model")


def repeated_words(words: Words, hashes: np.ndarray, size: int = WINDOW_WORDS) -> np.ndarray:
    """Per row: words inside windows of `size` words that occur twice or more in the row."""
    found, first = windows(hashes, words.row, size)
    row = words.row[first]
    order = np.lexsort((found, row))
    same = (found[order][1:] == found[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + size, -1)
    return np.bincount(words.row[np.cumsum(cover[:-1]) > 0], minlength=words.rows)


def repeated_lines(words: Words, raw: np.ndarray, at: np.ndarray, first: int, last: int, tables: Powers) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line."""
    lines = Words(raw, at, first, last, tables, fold=False, separator=LINE_END)
    told = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    row, name = lines.row[told], lines.hashes()[told]
    order = np.lexsort((name, row))
    same = (name[order][1:] == name[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=last - first)


SCORED = "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, bits double"


def _scored(batches: Iterator[pa.RecordBatch], packed: dict[str, list] | None) -> Iterator[pa.RecordBatch]:
    tables, known = Powers(), {}
    for batch in batches:
        names = batch.column("lang").to_pylist()
        raw, at = text_buffer(batch.column("text"))
        for first, last in chunks(at):
            words = Words(raw, at, first, last, tables, fold=False)
            sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[words.at])  # noqa: B023, E731
            bits = np.full(last - first, np.nan)
            code, row = grams(words.bytes, words.at)
            here = np.array(names[first:last], object)
            for lang in dict.fromkeys(names[first:last]) if packed is not None else ():
                if lang not in known:
                    known[lang] = Sorted(packed[lang]) if lang in packed else None
                if known[lang] is None:
                    continue
                mine = here == lang
                use = mine[row]
                n = np.bincount(row[use], minlength=last - first)
                total = np.bincount(row[use], known[lang].score(code[use]), last - first)
                bits = np.where(mine & (n > 0), -total / np.maximum(n, 1), bits)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "lang": batch.column("lang").slice(first, last - first),
                    "text_hash": batch.column("text_hash").slice(first, last - first),
                    "n_words": pa.array(words.per_row.astype(np.int64)),
                    "word_chars": pa.array(sums(~SEPARATOR[words.bytes] & ((words.bytes & 0xC0) != 0x80)).astype(np.int64)),
                    "n_symbols": pa.array(sums(MARKED[words.bytes]).astype(np.int64)),
                    "n_dup_lines": pa.array(repeated_lines(words, raw, at, first, last, tables).astype(np.int64)),
                    "n_repeat_words": pa.array(repeated_words(words, words.hashes()).astype(np.int64)),
                    "n_grams": pa.array(np.bincount(row, minlength=last - first)),
                    "bits": pa.array(bits, from_pandas=True),
                }
            )


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted n-grams of each text."""
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        for first, last in chunks(at):
            code, row = grams(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            order = np.lexsort((code, row))
            code, row = code[order], row[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            own = batch.slice(first, last - first).take(pa.array(row[begin]))
            yield pa.RecordBatch.from_pydict({"lang": own.column("lang"), "text_hash": own.column("text_hash"), "code": pa.array(code[begin].view(np.int64)), "n": pa.array(np.diff(np.append(begin, len(code))))})


def joined_bits(docs: DataFrame, model: DataFrame, limit: int) -> DataFrame:
    """lang, text_hash, bits by joins of each text's n-grams with the model's table."""
    rows = docs.select("lang", "text_hash", "text").mapInArrow(_told, "lang string, text_hash long, code long, n long")
    rows = rows.groupBy("lang", "text_hash", "code").agg(F.max("n").alias("n"))  # equal texts tell the same
    level = {o: written(model.filter(F.col("ord") == o).select("lang", F.col("code").alias("key"), "logp", "back"), f"order{o}") for o in range(ORDER + 1)}
    code, total = F.col("code"), F.lit(0.0)
    for order in range(ORDER, -1, -1):
        own = F.lit(0).cast("long") if order == 0 else code.bitwiseAND(F.lit((1 << UNIT_BITS * order) - 1).cast("long")) if order < ORDER else code
        names = {"logp": f"p{order}", "back": f"b{order}"}
        rows = lookup(rows.withColumn("key", own), level[order].select("lang", "key", F.col("logp").alias(names["logp"])), ["lang", "key"], "left", limit).drop("key")
        if order < ORDER:  # the context of the n-gram that is one longer
            above = F.shiftrightunsigned(code, UNIT_BITS)
            context = above.bitwiseAND(F.lit((1 << UNIT_BITS * order) - 1).cast("long")) if order else F.lit(0).cast("long")
            rows = lookup(rows.withColumn("key", context), level[order].select("lang", "key", F.col("back").alias(names["back"])), ["lang", "key"], "left", limit).drop("key")
    for order in range(0, ORDER + 1):
        rest = total + F.coalesce(F.col(f"b{order - 1}"), F.lit(0.0)) if order else total
        total = F.coalesce(F.col(f"p{order}").cast("double"), rest)
    return rows.groupBy("lang", "text_hash").agg((-F.sum(F.col("n") * total) / F.sum("n")).alias("bits"))


def word_bits() -> Column:
    return F.col("bits") * F.col("n_grams") / F.col("n_words")


def bands(scored: DataFrame) -> DataFrame:
    """lang, mid, iqr, word_mid, word_iqr: from exact quartiles, in steps of 0.001 and 0.01 bits, over all documents."""
    known = scored.filter("bits is not null and n_words > 0")

    def quartiles(value: Column, steps: int, prefix: str) -> DataFrame:
        counts = known.groupBy("lang", F.round(value * steps).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n"))
        q = lambda p: F.percentile("step", F.lit(p), F.col("n")) / steps
        both = counts.groupBy("lang").agg(q(0.25).alias("q1"), q(0.75).alias("q3"))
        return both.select("lang", ((F.col("q1") + F.col("q3")) / 2).alias(f"{prefix}mid"), (F.col("q3") - F.col("q1")).alias(f"{prefix}iqr"))

    return quartiles(F.col("bits"), 1000, "").join(quartiles(word_bits(), 100, "word_"), "lang")


def assess(docs: DataFrame, width: float = WIDTH, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """The counts, bits, word_bits, the bands, base_failed and kept of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_key(F.col("lang")).alias("lang"), "text", F.xxhash64("text").alias("text_hash"))
    model = models(rows.select("lang", "text"))
    packed = None
    if 16 * model.count() <= model_bytes:
        shards: dict[str, list] = {}
        for r in model.mapInArrow(_packed, "lang string, hashes binary, logp binary, back binary").collect():  # model_bytes at most
            shards.setdefault(r["lang"], []).append((bytes(r["hashes"]), bytes(r["logp"]), bytes(r["back"])))
        packed = rows.sparkSession.sparkContext.broadcast(shards)
    scored = written(rows.mapInArrow(lambda b: _scored(b, packed.value if packed else None), SCORED), "scored")
    if packed is None:
        found = written(joined_bits(rows, model, model_bytes), "bits")
        scored = written(scored.drop("bits").join(found, ["lang", "text_hash"], "left"), "scored")
    limits = written(bands(scored), "bands")
    joined = scored.join(small(limits), "lang", "left").withColumn("word_bits", F.when(F.col("n_words") > 0, word_bits()))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    within = lambda value, of, spread, n: F.abs(F.col(value) - F.col(f"{of}mid")) <= width * F.sqrt(F.col(f"{of}iqr") ** 2 + spread**2 / F.col(n))
    inside = F.coalesce(within("bits", "", SPREAD, "n_grams") & within("word_bits", "word_", WORD_SPREAD, "n_words"), F.lit(True))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "word_bits")

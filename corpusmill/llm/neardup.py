"""Near-duplicate classes by DartMinHash signatures.

A text's elements are its five-word shingles (all words of a shorter text), each
of weight 1 however often it is said: links are decided on sets of shingles, so
signatures estimate the similarity of sets too, and a text said twice still
meets itself. Each element throws hashed darts into unit cells of
weight x rank: a Poisson number of darts a cell, each with a place in the cell
and one of the signature's coordinates, all functions of the element's hash.
Darts that land inside the element's weight count; each coordinate keeps the one
of the lowest rank. Two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. Ranks are searched upwards from a range that
should fill all coordinates, so a text costs about one hash an element.

Signatures are cut into bands; texts that share a band meet in a bucket. Every
text of a bucket is compared with its hub (the text that shares most bands with
others). The bucket is dealt into blocks of bounded size, and what the hub's class
doesn't take in is sent to all of them: first for its best partner of each
block, then, with the classes these made, for all partners of other classes
whose spread (counts of elements by hash) leaves room for enough in common.

A large bucket is first parted by coordinates: signatures that agree in `least` of
their coordinates share one outside the least - 1 that are the commonest of each,
so its texts meet by these rarer ones alone. Texts with one passage in common
meet no more by that passage, and no pair that would be verified is lost.

Equal texts are one node from the start: they are folded by hash before
anything else and unfolded at the end.

Defined cases: a null text is alone in its class; texts of no words are equal
only if they are the same string; repeated rows share a class; a class is named
by its smallest doc_id (null doc_ids are largest); no rows give no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import trimmed
from .common import lookup, small, table, text_key, written
from .textkernel import Powers, Words, chunks, mix, text_buffer, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Of the signature's coordinates; at similarity 0.8 fewer agree once in 20,000 pairs.
AGREE = 0.6
BLOCK = 96
#: Buckets of more rows are parted by coordinates; also the most rows sent to a block at once, on average.
LARGE = 33 * BLOCK
#: Cells of a spread.
CELLS = 128


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle, repeats included."""
    hashes = words.hashes()
    found, first = windows(hashes, words.row, size)
    row = words.row[first]
    short = np.flatnonzero((words.per_row > 0) & (words.per_row < size))
    if len(short):
        begins = np.concatenate([[0], np.cumsum(words.per_row)])[short]
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = words.per_row[short] > j
            whole[has] = mix(whole[has] * np.uint64(31) + hashes[begins[has] + j])
        found, row = np.concatenate([found, whole]), np.concatenate([row, short])
    return row, found


def weighted(row: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) in order, and their counts."""
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(new)
    return row[at], found[at], np.diff(np.append(at, len(row)))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])


def throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, low: int, high: int, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of rank low..high-1 (cells) under the row's limit: slot row*k+coordinate, rank, name."""
    cells = np.ceil(weight).astype(np.int64) * (high - low)
    of = np.repeat(np.arange(len(row)), cells)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    column, level = nth // (high - low), low + nth % (high - low)
    seed = mix(element[of] + mix((column * 65_536 + level + 1).astype(np.uint64)))
    count = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    dart = np.repeat(np.arange(len(of)), count)
    which = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
    name = mix(seed[dart] + (which + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    rank = level[dart] + (name >> np.uint64(32)).astype(np.float64) * 2.0**-32
    keep = rank < limit[row[of[dart]]]
    dart, name, rank = dart[keep], name[keep], rank[keep]
    place = mix(name)
    inside = column[dart] + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < weight[of[dart]]
    dart, name, rank, place = dart[inside], name[inside], rank[inside], place[inside]
    slot = row[of[dart]] * k + ((place >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    return slot, rank, name


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k names of earliest darts; 0 for rows without elements.

    Most rows fill within the lowest ranks, where few darts are kept; the others search whole cells.
    """
    found = np.zeros((rows, k), np.uint32)
    mass = np.bincount(row, weight, rows)
    limit = np.zeros(rows)
    np.divide(k * (math.log(k) + 5), mass, out=limit, where=mass > 0)
    slot, rank, name = earliest(*throw(row, element, weight, 0, 1, np.minimum(limit, 1.0), k))
    found.reshape(-1)[slot] = (name & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    open_ = np.flatnonzero((mass > 0) & (np.bincount(slot // k, minlength=rows) < k))
    if len(open_):
        number = np.full(rows, -1)
        number[open_] = np.arange(len(open_))
        own = number[row] >= 0
        found[open_] = _from_start(number[row[own]], element[own], weight[own], len(open_), k)
    return found


def earliest(slot: np.ndarray, rank: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dart of the lowest rank of each slot."""
    order = np.lexsort((name, rank, slot))
    slot, rank, name = slot[order], rank[order], name[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    return slot[first], rank[first], name[first]


def _from_start(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Signatures with whole cells from rank 0 on."""
    found = np.zeros((rows, k), np.uint32)
    todo = np.ones(rows, bool)
    low, high = 0, 1
    slot, rank, name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    while todo.any():
        own = todo[row]
        more = throw(row[own], element[own], weight[own], low, high, np.full(rows, float(high)), k)
        slot, rank, name = (np.concatenate(x) for x in zip((slot, rank, name), more, strict=True))
        slot, rank, name = earliest(slot, rank, name)
        full = todo & (np.bincount(slot // k, minlength=rows) == k)
        done = full[slot // k]
        found.reshape(-1)[slot[done]] = (name[done] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        todo &= ~full
        keep = todo[slot // k]
        slot, rank, name = slot[keep], rank[keep], name[keep]
        low, high = high, 2 * high
    return found


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    tables, k = Powers(), bands * rows
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        for first, last in chunks(at):
            row, found = shingles(Words(raw, at, first, last, tables))
            row, element, _ = weighted(row, found)
            signed = signatures(row, element, np.ones(len(row)), last - first, k)
            has = np.flatnonzero(np.bincount(row, minlength=last - first))
            yield pa.RecordBatch.from_pydict(
                {
                    "_id": batch.column("_id").slice(first, last - first).take(pa.array(has)),
                    "_node": batch.column("_node").slice(first, last - first).take(pa.array(has)),
                    "signature": pa.array([x.tobytes() for x in signed[has]], pa.binary()),
                }
            )
    trimmed()


def _band_keys(signature: bytes, bands: int, rows: int) -> np.ndarray:
    names = np.frombuffer(signature, np.uint32).reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), names.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + names[:, :, j])
    return key.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _band_keys(b"".join(batch.column("signature").to_pylist()), bands, rows)
        yield pa.RecordBatch.from_pydict(
            {"_node": pa.array(np.repeat(batch.column("_node").to_numpy(), bands)), "bucket": pa.array(keys.reshape(-1))}
        )


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            same = _agreement(_signature_matrix(batch.column("signature_a")), _signature_matrix(batch.column("signature_b")))
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))


def _across(batches: Iterator[pa.RecordBatch], least: float, similarity: float, best: bool) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (bucket, block): agreeing pairs of a sent row and a dealt one of another component; if `best`, one for each sent row.

    At most min(shared) of two sets' elements can be in both, and at most the cells' lesser counts.
    """

    def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
        bucket, block, sent, node, component, size, shared, signed, spread = columns
        edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])))
        a, b = [], []
        for first, last in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
            at = np.arange(first, last)
            dealt = at[~sent[first:last]]
            for i in at[sent[first:last]]:
                other = dealt[component[dealt] != component[i]]
                both = np.minimum(shared[other], shared[i])
                other = other[both >= similarity * (size[other] + size[i] - both)]
                both = np.minimum(spread[other], spread[i]).sum(axis=1, dtype=np.int64)
                other = other[both >= similarity * (size[other] + size[i] - both)]
                same = (signed[other] == signed[i]).mean(axis=1)
                other, same = other[same >= least], same[same >= least]
                if best and len(other):
                    other = other[[np.lexsort((node[other], -same))[0]]]
                a.append(np.minimum(node[other], node[i]))
                b.append(np.maximum(node[other], node[i]))
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not len(batch):
            continue
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "block", "sent", "_node", "component", "size", "shared")]
        new.append(_signature_matrix(batch.column("signature")))
        new.append(_signature_matrix(batch.column("spread")))
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        if len(other):
            cut = other[-1] + 1
            yield pairs([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None:
        yield pairs(held)


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_node and token: a coordinate's number and its name."""
    for batch in batches:
        if len(batch):
            names = _signature_matrix(batch.column("signature")).astype(np.int64)
            token = names + (np.arange(names.shape[1], dtype=np.int64) << 32)
            yield pa.RecordBatch.from_pydict({"_node": pa.array(np.repeat(batch.column("_node").to_numpy(), names.shape[1])), "token": pa.array(token.reshape(-1))})


def rarer_tokens(signs: DataFrame, least: int) -> DataFrame:
    """_node, token: all but the least - 1 commonest coordinates of each signature, without those that one signature alone has."""
    tokens = written(signs.select("_node", "signature").mapInArrow(_coordinates, "_node long, token long"), "coordinates")
    counts = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    commonest = Window.partitionBy("_node").orderBy(F.desc("n"), F.desc("token"))
    return lookup(tokens, counts, ["token"]).withColumn("nth", F.row_number().over(commonest)).filter(F.col("nth") >= least).select("_node", "token")


KNOWN = ["_node", "component", "size", "shared"]


def met(placed: DataFrame, tokens: DataFrame | None, block: int, large: int) -> DataFrame:
    """bucket, block, sent and KNOWN: the rows that meet, about `block` dealt ones and `large` sent ones in each (bucket, block).

    `tokens` (of `rarer_tokens`) part buckets of more than `large` rows; None if there are none.
    """
    placed = placed.withColumn("sent", F.col("component") != F.col("main"))
    rows = placed.filter(F.col("n") <= large).select("bucket", "n", F.lit(1).cast("long").alias("turns"), "sent", *KNOWN)
    if tokens is not None:
        far = placed.filter(F.col("n") > large).drop("n").join(tokens, "_node")
        far = written(far.select(F.xxhash64("bucket", "token").alias("bucket"), "sent", *KNOWN), "parted")
        parts = far.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count_if("sent") / large).alias("turns"))
        far = lookup(far, written(parts.filter("n > 1 AND turns > 0"), "parts"), ["bucket"])
        rows = rows.union(far.select(*rows.columns))
    blocks = F.ceil(F.col("n") / block)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own, turn = F.pmod(F.xxhash64("_node", "bucket"), blocks), F.pmod(F.xxhash64("bucket", "_node"), F.col("turns"))
    dealt = rows.withColumn("turn", every(F.col("turns"))).select("bucket", (F.col("turn") * blocks + own).alias("block"), F.lit(False).alias("sent"), *KNOWN)
    sent = rows.filter("sent").withColumn("of", every(blocks)).select("bucket", (turn * blocks + F.col("of")).alias("block"), "sent", *KNOWN)
    return dealt.union(sent)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = Powers()
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        for first, last in chunks(at):
            row, element, _ = weighted(*shingles(Words(raw, at, first, last, tables)))
            ends = np.searchsorted(row, np.arange(last - first + 1))
            spread = np.bincount(row * CELLS + (element % np.uint64(CELLS)).astype(np.int64), minlength=(last - first) * CELLS).astype(np.uint32)
            yield pa.RecordBatch.from_pydict(
                {
                    "_node": batch.column("_node").slice(first, last - first),
                    "spread": pa.array([x.tobytes() for x in spread.reshape(-1, CELLS)], pa.binary()),
                    "elements": pa.array([element[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                }
            )
    trimmed()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("elements")]
        nodes = np.repeat(batch.column("_node").to_numpy(), [len(x) for x in each])
        yield pa.RecordBatch.from_pydict({"_node": pa.array(nodes), "element": pa.array(np.concatenate([np.zeros(0, np.int64), *each]))})


def _sizes(sets: DataFrame) -> DataFrame:
    """_node, size and shared: a set's elements, and those of them that another of the sets has too."""
    elements = sets.mapInArrow(_elements, "_node long, element long")
    alone = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.first("_node").alias("_node")).filter("n = 1")
    alone = alone.groupBy("_node").agg(F.count(F.lit(1)).alias("alone"))
    rows = sets.select("_node", F.expr("length(elements) div 8").alias("size")).join(alone, "_node", "left")
    return rows.select("_node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("elements_a"), batch.column("elements_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            n = 0
            if min(len(x), len(y)) >= least * max(len(x), len(y)):
                both = np.concatenate([x, y])
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
            keep.append(n >= least * (len(x) + len(y) - n))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """_node, component (the smallest node) of links a, b: alternating stars until nothing changes."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    was = print_of(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small_.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        now = print_of(edges)
        if now == was:
            return edges.select(F.col("u").alias("_node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        was = now


def links(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, agree: float = AGREE, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """a, b: verified links between different texts, by node; enough of them to connect every class."""
    keyed = docs.filter("text is not null").select(*text_key(), node().alias("_node"), "text")
    kind = "_id long, _node long, signature binary"
    signed = keyed.select("_id", "_node", "text").mapInArrow(lambda b: _signed(b, bands, rows), kind)
    signed = written(signed.groupBy("_node").agg(F.min("_id").alias("_id"), F.first("signature").alias("signature")), "signed")

    banded = signed.select("_node", "signature").mapInArrow(lambda b: _banded(b, bands, rows), "_node long, bucket long")
    banded = written(banded, "banded")
    counts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = written(banded.join(counts, "bucket"), "live")
    shared = live.groupBy("_node").agg(F.sum("n").alias("shared"))
    hubs = live.join(shared, "_node").groupBy("bucket").agg(F.max(F.struct("shared", F.col("_node").alias("hub"))).alias("h"))
    hubs = written(hubs.select("bucket", "h.hub"), "hubs")

    nodes = written(live.select("_node").distinct(), "nodes")
    signs = written(signed.join(nodes, "_node", "left_semi"), "signs")
    reps = written(signs.select("_node", "_id"), "reps")
    sets = keyed.join(small(reps), ["_node", "_id"], "left_semi").select("_node", "text").mapInArrow(_shingle_sets, "_node long, spread binary, elements binary")
    sets = written(sets, "sets")
    ends = lambda df, c: (df.select(F.col("_node").alias("a"), F.col(c).alias(f"{c}_a")), df.select(F.col("_node").alias("b"), F.col(c).alias(f"{c}_b")))

    def verified(pairs: DataFrame) -> DataFrame:
        set_a, set_b = ends(sets, "elements")
        both = pairs.join(set_a, "a").join(set_b, "b").select("a", "b", "elements_a", "elements_b")
        return both.mapInArrow(lambda b: _verified(b, similarity), "a long, b long")

    sign_a, sign_b = ends(signs, "signature")
    to_hub = live.join(hubs, "bucket").filter("hub <> _node").select(F.least("_node", "hub").alias("a"), F.greatest("_node", "hub").alias("b")).distinct()
    to_hub = to_hub.join(sign_a, "a").join(sign_b, "b").mapInArrow(lambda b: _agreeing(b, agree), "a long, b long")
    found = written(verified(to_hub), "links")

    def apart() -> DataFrame:
        """bucket, n, _node, component, main of buckets that hold texts outside the hub's component."""
        joined = written(components(found), "joined")
        placed = live.join(joined, "_node", "left").withColumn("component", F.coalesce("component", "_node"))
        hub = hubs.join(joined.withColumnRenamed("_node", "hub"), "hub", "left").select("bucket", F.coalesce("component", "hub").alias("main"))
        placed = written(placed.join(hub, "bucket"), "placed")
        some = placed.filter("component <> main").select("bucket").distinct()
        return written(placed.join(some, "bucket", "left_semi"), "apart")

    tokens = sizes = None
    crowded = live.filter(F.col("n") > large).select("_node").distinct()
    for best in (True, False):
        placed = apart()
        if sizes is None:
            sizes = written(_sizes(sets.select("_node", "elements").join(placed.select("_node").distinct(), "_node", "left_semi")), "sizes")
        able = sizes.filter(F.col("shared") >= similarity * F.col("size"))  # others have no partner
        if tokens is None and not crowded.isEmpty():
            tokens = written(rarer_tokens(signs.join(crowded, "_node", "left_semi").join(able, "_node", "left_semi"), math.ceil(agree * bands * rows)), "tokens")
        rows_ = met(placed.join(able, "_node"), tokens, block, large)
        rows_ = rows_.join(signs.select("_node", "signature"), "_node").join(sets.select("_node", "spread"), "_node")
        rows_ = rows_.select("bucket", "block", "sent", *KNOWN, "signature", "spread")
        rows_ = rows_.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
        more = rows_.mapInArrow(lambda b, best=best: _across(b, agree, similarity, best), "a long, b long").distinct()
        found = found.union(written(verified(more), "links"))
    return found


def node():
    """Names a text by its content."""
    return F.xxhash64("text", F.octet_length("text"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """_id, _text (text_key of a row), doc_id, component (null: a null text, alone) and class_id, the class's smallest doc_id."""
    rows = docs.select(*text_key(), F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), node()).alias("_node"))
    joined = components(links(docs, **options))
    known = rows.filter("_node is not null").join(joined, "_node", "left").withColumn("component", F.coalesce("component", "_node"))
    known = written(known.select("_id", "_text", "doc_id", "component"), "members")
    named = written(known.groupBy("component").agg(F.min("doc_id").alias("class_id")), "named")
    known = known.join(named, "component").select("_id", "_text", "doc_id", "component", "class_id")
    alone = rows.filter("_node is null").select("_id", "_text", "doc_id", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id"))
    return known.union(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first row, by doc_id, of each class; rows of null text stay."""
    found = written(classes(docs, **options).select("_id", "_text", "component"), "classes")
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("_id", "_text")).alias("k")).select("k._id", "k._text")
    first = written(first.union(found.filter("component is null").select("_id", "_text")), "first")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *text_key())  # whatever names docs have
    kept = rows.join(small(first), ["_id", "_text"], "left_semi")
    repeated = found.filter("component is not null").groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():  # rows equal in doc_id and text
        kept = kept.filter("_row.text is null").unionByName(kept.filter("_row.text is not null").dropDuplicates(["_id", "_text"]))
    return kept.select("_row.*")


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")

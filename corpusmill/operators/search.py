"""Keyword and vector search of a stated query set, with fallback from one to the other.

The query set is small and known when the plan is built: a row of the corpus
meets all of it at once and yields its hits, and hits are reduced to the best of
each query before they are shuffled. Keyword terms go into one automaton, so a
text is read once however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.data import keyword_relevance, normalised, relevance
from ..functions.text import query_terms
from ..session import small_batches, trimmed

BROADCAST_BYTES = 16 << 20
#: Similarities held at once when a batch of rows meets the stated queries.
CELLS = 1 << 22
#: Rows and queries of a scope that meet in one task where the queries are too many to be stated.
ROW_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 13
#: Far above the rounding of a product of two vectors of length one.
ROUNDING = 1e-9
SIMILARITY = 0.25


def keyword_hits(rows: DataFrame, content: str, queries: DataFrame) -> DataFrame:
    """rows with query_id for each query (query_id, query) of which a term stands in `content`; queries without terms find nothing."""
    stated = queries.select(F.col("query_id").cast("long"), query_terms(F.col("query")).alias("terms"))
    size = stated.agg(F.sum(F.octet_length(F.array_join("terms", " ")) + 50)).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError(f"the queries' terms are {size} bytes; ask them in parts of at most {BROADCAST_BYTES}")
    known = stated.collect()  # of the size just measured
    of: dict[str, list[int]] = {}
    for r in known:
        for term in r["terms"] or []:
            of.setdefault(term, []).append(r["query_id"])

    @F.pandas_udf("array<long>")
    def hits(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, ids in of.items():
            found.add_word(term, ids)
        found.make_automaton()
        for texts in columns:
            yield pd.Series([sorted({i for _, ids in found.iter(t) for i in ids}) if t and of else [] for t in texts], dtype=object)
        trimmed()

    small_batches(rows.sparkSession)
    return rows.select("*", F.explode(hits(F.lower(F.coalesce(F.col(content), F.lit(""))))).alias("query_id"))


def keyword_best(rows: DataFrame, key: str, content: str, queries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """query_id, scope..., the key of the best row: any term, then the longest content, then the smallest key."""
    scope = scope or []
    told = rows.select(*scope, key, F.length(content).cast("long").alias("_length"), content)
    hits = keyword_hits(told, content, queries)
    best = F.max_by(F.struct(key, "_length"), F.struct("_length", -F.col(key)))
    return hits.groupBy("query_id", *scope).agg(best.alias("b")).select("query_id", *scope, F.col(f"b.{key}").alias(key), F.col("b._length").alias("content_length"))


def keyword_topk(rows: DataFrame, key: str, content: str, queries: DataFrame, k: int = 10) -> DataFrame:
    hits = keyword_hits(rows.select(key, F.length(content).cast("long").alias("content_length"), content), content, queries).drop(content)
    order = Window.partitionBy("query_id").orderBy(F.desc("content_length"), key)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grouped(scope: list[pa.Array], vectors: pa.Array) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each scope and length."""
    start = vectors.offsets.to_numpy()
    flat, length = vectors.values.to_numpy(zero_copy_only=False), np.diff(start)
    groups: dict[tuple, list[int]] = {}
    for i, at in enumerate(zip(*[c.to_pylist() for c in scope], length.tolist(), strict=True)):
        groups.setdefault(at, []).append(i)
    return {at: (np.array(rows), flat[start[rows][:, None] + np.arange(at[-1])]) for at, rows in groups.items()}


def _nearest(batches: Iterator[pa.RecordBatch], key: str, stated: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a row and a query of its scope, without those that k rows of the same batch surpass."""
    stated = stated.combine_chunks().to_batches()[0]
    asked = _grouped(stated.columns[2:], stated.column("_q"))
    for batch in batches:
        for at, (rows, vectors) in _grouped(batch.columns[2:], batch.column("_v")).items():
            if at not in asked:
                continue
            ids, queries = asked[at]
            n, step = len(rows), max(1, CELLS // len(rows))
            for first in range(0, len(ids), step):
                some = queries[first : first + step]
                near = vectors @ some.T
                least = np.partition(near, n - min(k, n), axis=0)[n - min(k, n)] - ROUNDING
                r, q = np.nonzero(~(near < least))
                yield pa.RecordBatch.from_arrays(
                    [
                        stated.column("query_id").take(pa.array(ids[first + q])),
                        batch.column(key).take(pa.array(rows[r])),
                        pa.array((vectors[r] * some[q]).sum(axis=1)),  # the same for equal vectors, wherever they stand
                    ],
                    ["query_id", key, "similarity"],
                )


def _firsts(batch: pa.RecordBatch, key: str, k: int) -> pa.RecordBatch:
    """The batch without copies of a vector that k rows of smaller keys hold too."""
    vectors, seen, kept = batch.column("_v"), {}, []
    start, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    for i in np.argsort(batch.column(key).to_numpy(zero_copy_only=False), kind="stable"):
        held = flat[start[i] : start[i + 1]].tobytes()
        seen[held] = seen.get(held, 0) + 1
        if seen[held] <= k:
            kept.append(i)
    return batch.take(pa.array(kept, pa.int64()))


def _met_in_blocks(left: DataFrame, right: DataFrame, key: str, scope: list[tuple[str, str]], k: int, kinds: str) -> DataFrame:
    """What `_nearest` finds for each block of a scope's rows and each block of its queries; any task holds one of each, however large a scope is."""
    blocks = lambda df, by, size: -(-(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1) // size)
    ours, theirs = [a for a, _ in scope], [b for _, b in scope]
    types = dict(left.dtypes)
    right = right.select("query_id", "_q", *[F.col(b).cast(types[a]).alias(b) for a, b in scope])
    n_rows, n_queries = blocks(left, ours, ROW_BLOCK), blocks(right, theirs, QUERY_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = left.withColumn("_row_block", place(key, n_rows)).withColumn("_query_block", each(n_queries))
    right = right.withColumn("_query_block", place("query_id", n_queries)).withColumn("_row_block", each(n_rows))

    def met(rows: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([queries.schema.field("query_id"), rows.schema.field(key), pa.field("similarity", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return kind.empty_table()
        batch = _firsts(rows.select([key, "_v", *ours]).combine_chunks().to_batches()[0], key, k)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=kind) for b in _nearest([batch], key, queries.select(["query_id", "_q", *theirs]), k)], kind)

    ends = ["_row_block", "_query_block"]
    return left.groupBy(*ours, *ends).cogroup(right.groupBy(*theirs, *ends)).applyInArrow(met, kinds)


def vector_topk(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, on: dict[str, str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, key, rank, similarity of the k nearest rows in each query's scope.

    queries: query_id, query (a vector) and scope columns; `on` maps a column of rows to one of queries. The zero vector finds nothing,
    nor does a null scope. Queries of up to `limit` bytes go to every task, which multiplies matrices; more meet the rows by scope, in blocks of both.
    """
    left = rows.select(F.col(key), normalised(F.col(vector)).alias("_v"), *[F.col(a).alias(f"_r_{a}") for a in on])  # lengths once, not once a pair
    right = queries.select("query_id", normalised(F.col("query")).alias("_q"), *[F.col(b).alias(f"_q_{b}") for b in on.values()])
    left, right = left.dropna(subset=[c for c in left.columns if c != key]), right.dropna(subset=[c for c in right.columns if c != "query_id"])
    size = right.agg(F.sum(8 * F.size("_q") + 64 * (1 + len(on)))).first()[0] or 0
    kinds = f"query_id {dict(right.dtypes)['query_id']}, `{key}` {dict(left.dtypes)[key]}, similarity double"
    if 0 < size <= limit:
        stated = right.toArrow()  # of the size just measured
        met = left.mapInArrow(lambda b: _nearest(b, key, stated, k), kinds)
    else:
        met = _met_in_blocks(left, right, key, [(f"_r_{a}", f"_q_{b}") for a, b in on.items()], k, kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_fallback(vector: DataFrame, keyword: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """query_id, branch, hit, relevance_pct: a query's vector hits of at least `least`, or else its keyword hits; the two never mix.

    vector: query_id, hit, similarity; keyword: query_id, hit.
    """
    near = vector.filter(F.col("similarity") >= least)
    rest = keyword.join(near.select("query_id").distinct(), "query_id", "left_anti")
    return near.select("query_id", F.lit("vector").alias("branch"), "hit", relevance(F.col("similarity")).alias("relevance_pct")).unionByName(
        rest.select("query_id", F.lit("keyword").alias("branch"), "hit", keyword_relevance(F.lit(1)).alias("relevance_pct"))
    )


def auto_mapped(vector: DataFrame, keyword: DataFrame, known: DataFrame, severity: str = "minor") -> DataFrame:
    """finding, clause, branch, relevance_pct, severity, inserted: a proposal for each finding, by its vector hit or else its keyword hit.

    vector and keyword as for with_fallback, one hit a query; known (finding): findings that have a mapping, which stays.
    """
    found = with_fallback(vector, keyword).withColumnsRenamed({"query_id": "finding", "hit": "clause"})
    mapped = known.select("finding").distinct().withColumn("_known", F.lit(True))
    return found.join(mapped, "finding", "left").withColumn("severity", F.lit(severity)).withColumn("inserted", F.col("_known").isNull()).drop("_known")


def in_scope(collection: Column, standard: Column, language: Column, name: str, lang: str) -> Column:
    """Rows of a standard's own collection or the shared older one, of that standard and language."""
    own = f"iso-standards-{name}"
    return ((collection == own) | (collection == "iso-standards")) & (standard == name) & (language == lang)

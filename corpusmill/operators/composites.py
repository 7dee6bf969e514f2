"""Model calls over parts of texts, and what puts their replies together again. The backend is a seam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sort_key
from ..functions.models import lists_transformer, transformer
from ..functions.replies import clauses
from ..functions.text import blank, dense_length, hebrew_body, packed, segments, short_of, strip
from .structure import merged_segments

#: Calls under way at a time in a task.
TRANSLATING, EXTRACTING = 3, 4


def translated(rows: DataFrame, scope: list[str], backend: Callable[[list[str]], list], source: str, target: str, most: int = 2800, workers: int = TRANSLATING, **retry) -> DataFrame:
    """scope, clause_id, title, body, error, sort_order: sections translated title first, then body by parts.

    A part that fails, comes back empty or much too short makes the whole section an error; such rows have no title and body.
    """
    call, calls = (made(backend, workers=workers, **retry) for made in (transformer, lists_transformer))
    body = F.coalesce("body", F.lit(""))
    rows = rows.withColumn("body", hebrew_body(body) if source == "he" else body)
    if source == target:
        return rows.select(*scope, "clause_id", "title", "body", F.lit(None).cast("string").alias("error"), sort_key(F.col("clause_id")).alias("sort_order"))
    parts = F.filter(packed(F.col("body"), most), lambda p: p != "")
    told = rows.select(*scope, "clause_id", "title", "body", parts.alias("_parts"))
    told = told.withColumn("_title", call(F.coalesce("title", F.lit("")))).withColumn("_told", calls(F.col("_parts")))
    told = told.withColumn("_title", F.coalesce(F.nullif(strip(F.col("_title")), F.lit("")), "title"))
    told = told.withColumn("_told", F.transform("_told", lambda t: strip(F.coalesce(t, F.lit("")))))
    told = told.withColumn("_dense", F.transform("_told", dense_length))
    wrong = lambda d, n: F.when(F.get("_told", n) == "", "empty").when(short_of(F.get("_parts", n), d), "too short")
    wrong = F.transform("_dense", lambda d, n: F.concat(F.lit("part "), (n + 1).cast("string"), F.lit(": "), wrong(d, n)))
    dense = F.aggregate("_dense", F.lit(0), lambda a, d: a + d)
    error = F.coalesce(F.get(F.filter(wrong, lambda e: e.isNotNull()), F.lit(0)), F.when(short_of(F.col("body"), dense), "body: too short"))
    both = told.select(*scope, "clause_id", "_title", F.array_join("_told", "\n\n").alias("_body"), error.alias("error"))
    said = hebrew_body(F.col("_body")) if target == "he" else F.col("_body")
    keep = lambda c: F.when(F.col("error").isNull(), c)
    return both.select(*scope, "clause_id", keep(F.col("_title")).alias("title"), keep(said).alias("body"), "error", sort_key(F.col("clause_id")).alias("sort_order"))


def extracted(docs: DataFrame, key: str, text: str, backend: Callable[[list[str]], list], most: int = 6000, overlap: int = 250, least_preamble: int = 0, nested: bool = True, workers: int = EXTRACTING, **retry) -> tuple[DataFrame, DataFrame]:
    """Sections a model finds in texts, segment by segment, and (key, n_segments, n_failed) of texts that gave none.

    Failed segments are left out.
    """
    parts = docs.select(key, F.posexplode(segments(F.col(text), most, overlap, least_preamble)).alias("segment", "part")).filter(~blank(F.col("part")))
    replies = parts.select(key, "segment", clauses(nested)(transformer(backend, workers=workers, **retry)(F.col("part"))).alias("found"))
    items = replies.select(key, "segment", F.posexplode("found").alias("n", "x")).select(key, "segment", "n", "x.*")
    found = merged_segments(items, [key], ["segment", "n"], core_only=nested)
    sums = replies.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("found").isNull()).alias("n_failed"))
    return found, sums.join(found.select(key).distinct(), key, "left_anti")

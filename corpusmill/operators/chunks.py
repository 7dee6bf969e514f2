"""Overlapping character windows of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1200, 200


def windows(text: Column, size: int | Column = SIZE, overlap: int | Column = OVERLAP) -> Column:
    """Windows that begin every size - overlap code points; the last may lie inside its predecessor, an empty text has one empty window."""
    text = F.coalesce(text, F.lit(""))
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    step = F.greatest(F.lit(1), size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), step)
    return F.transform(starts, lambda s: F.substring(text, s + 1, size))


def chunk(docs: DataFrame, text: str = "text", size: int | Column = SIZE, overlap: int | Column = OVERLAP) -> DataFrame:
    """docs without `text`, with chunk_index and content."""
    rest = [F.col(c) for c in docs.columns if c != text]
    rows = docs.select(*rest, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk_index", "content"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def clause_chunks(clauses: DataFrame, collection: Column, source: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The index rows of clauses: collection_id, source_path, chunk_index, content, metadata."""
    text = F.concat(F.col("clause_id"), F.lit(" "), F.col("title"), F.lit("\n\n"), F.col("body"))
    metadata = F.struct("standard", "language", "clause_id", "title")
    rows = clauses.select(collection.alias("collection_id"), source.alias("source_path"), metadata.alias("metadata"), text.alias("text"))
    return chunk(rows, "text", size, overlap).select("collection_id", "source_path", "chunk_index", "content", "metadata")

"""A stored chunk index that follows its sources: only what changed is embedded again, what vanished is deleted.

A snapshot is a folder of its own, named by version; the last complete one is the index. Vectors are found again by
the hash of a chunk's content, wherever the chunk stands now, so a text that moved, or is said twice, costs no call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.data import is_failed_embedding
from ..functions.ids import collection_id
from ..functions.models import embedder, hashed
from ..storage import removed
from .chunks import chunk, clause_chunks

KEY = ["collection_id", "source_path", "chunk_index"]
ROWS = "collection_id string, source_path string, chunk_index long, content string, content_sha string, metadata map<string,string>, embedding array<float>"


class ChunkStore:
    """Snapshots of an index in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        """Complete snapshots, the oldest first."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in system.listStatus(place)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(ROWS).parquet(f"{self.folder}/v{found[-1]}") if found else self.spark.createDataFrame([], ROWS)

    def publish(self, rows: DataFrame, keep: int = 2) -> int:
        """Writes the next snapshot, then removes all but the last `keep`."""
        found = self.versions()
        version = found[-1] + 1 if found else 1
        rows.select(*[F.col(f.split()[0]) for f in ROWS.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        for old in [*found, version][:-keep]:
            removed(self.spark, f"{self.folder}/v{old}")
        return version


def content_sha(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def seed_chunks(seeds: DataFrame) -> DataFrame:
    """The index rows of seed files (as sources.tables.seed_rows tells them), cut by their collection's sizes; standards lie in collections of their own."""
    own = F.when(F.coalesce("standard", F.lit("")) != "", collection_id(F.col("standard"))).otherwise(F.col("collection_id"))
    about = F.map_from_arrays(F.array(*[F.lit(c) for c in ("language", "standard", "edition", "sha256")]), F.array("language", "standard", "edition", "sha256"))
    rows = seeds.select(own.alias("collection_id"), "source_path", about.alias("metadata"), "text", "chunk_size", "chunk_overlap")
    return chunk(rows, "text", F.col("chunk_size"), F.col("chunk_overlap")).drop("chunk_size", "chunk_overlap").withColumn("content_sha", content_sha(F.col("content")))


def section_chunks(clauses: DataFrame, corpus: Column, name: Column, **sizes: int) -> DataFrame:
    """The index rows of parsed sections: a source for each, named by upload, file and clause."""
    path = F.concat(F.lit("uploads/"), corpus, F.lit("/"), name, F.lit("#"), F.col("clause_id"))
    rows = clause_chunks(clauses, collection_id(F.col("standard")), path, **sizes)
    about = F.map_from_arrays(F.array(*[F.lit(c) for c in ("standard", "language", "clause_id", "title")]), F.array("metadata.standard", "metadata.language", "metadata.clause_id", "metadata.title"))
    return rows.withColumn("metadata", about).withColumn("content_sha", content_sha(F.col("content")))


def changes(stored: DataFrame, fresh: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """KEY and change (kept, moved, changed, new, deleted) between an index and the chunks as they are now.

    `moved`: at a new place, or instead of another, stands a content that the index has somewhere. With `scope`, only rows of scopes that
    `fresh` has can be deleted; without, all that it has not.
    """
    old = stored.select(*KEY, F.col("content_sha").alias("_old"))
    if scope:
        old = old.join(fresh.select(*scope).distinct(), scope, "left_semi")
    both = fresh.select(*KEY, F.col("content_sha").alias("_new")).join(old, KEY, "full")
    known = stored.select(F.col("content_sha").alias("_new")).distinct().withColumn("_known", F.lit(True))
    both = both.join(known, "_new", "left")
    change = F.when(F.col("_new").isNull(), "deleted").when(F.col("_new") == F.col("_old"), "kept").when(F.col("_known"), "moved").when(F.col("_old").isNull(), "new").otherwise("changed")
    return both.select(*KEY, change.alias("change"))


def refreshed(stored: DataFrame, fresh: DataFrame, backend: Callable[[list[str]], list] = hashed, scope: list[str] | None = None, again: bool = False, **calls) -> DataFrame:
    """The next snapshot: the fresh chunks, with stored vectors where their content has one, others embedded (a content once).

    A failed embedding (zeros) is kept as null, and asked for again only if `again`. Rows of other scopes stay as they are if
    `scope` is given.
    """
    told = stored.filter(F.col("embedding").isNotNull()) if again else stored
    known = told.groupBy("content_sha").agg(F.first("embedding", ignorenulls=True).alias("embedding"))
    asked = fresh.select("content_sha", "content").dropDuplicates(["content_sha"]).join(known, "content_sha", "left_anti")
    vector = embedder(backend, **calls)(F.col("content"))
    made = asked.select("content_sha", vector.alias("embedding"))
    made = made.select("content_sha", F.when(~is_failed_embedding(F.col("embedding")), F.col("embedding")).alias("embedding"))
    found = fresh.join(known.unionByName(made), "content_sha", "left").select(*KEY, "content", "content_sha", "metadata", "embedding")
    if scope:
        found = found.unionByName(stored.join(fresh.select(*scope).distinct(), scope, "left_anti").select(*found.columns))
    return found

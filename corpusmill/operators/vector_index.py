"""An inverted file of vectors: stored by their nearest centroid, searched in the lists nearest to a query.

Centroids are spherical k-means, learned by Spark on a sample of at most `sample` rows (one for each hash slot). Every row is
stored in the folder of its list, so a search reads the folders that its queries need and
no other; a list that holds a large share of all rows is many files. Zero vectors, nulls and vectors of
another length than most are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.data import normalised
from .search import vector_topk

LISTS, PROBES, SAMPLE, ROUNDS, SEED = 100, 10, 25_600, 10, 5
#: Rows of a list that are written by one task.
FILE_ROWS = 100_000
LIST = "_list"


def _units(rows: DataFrame, vector: str) -> DataFrame:
    unit = F.transform(normalised(F.col(vector)), lambda x: x.cast("double"))
    return rows.withColumn(vector, unit).filter(F.col(vector).isNotNull())


def centroids(rows: DataFrame, key: str, vector: str, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """`lists` unit vectors at most, from a sample that doesn't grow with the rows."""
    slot = F.pmod(F.xxhash64(key), F.lit(sample))
    some = _units(rows.select(key, vector), vector).groupBy(slot.alias("slot")).agg(F.min_by(vector, F.struct(F.xxhash64(key), key)).alias("v"))
    sampled = some = some.select("v").persist()
    try:
        width = some.agg(F.mode(F.size("v"), deterministic=True)).first()[0]  # vectors of another length belong to another model
        if width is None:
            return np.zeros((0, 0))
        some = some.filter(F.size("v") == width).select(array_to_vector("v").alias("features"))
        found = np.array(KMeans(k=lists, maxIter=ROUNDS, seed=SEED, distanceMeasure="cosine").fit(some).clusterCenters())
    finally:
        sampled.unpersist()
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _nearest_lists(batches: Iterator[pa.RecordBatch], at: int, centers: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """The batch with a column of each row's `probes` nearest lists, the nearest first."""
    for batch in batches:
        vectors = batch.column(at)
        width = centers.shape[1]
        flat = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(-1, width) if len(batch) else np.zeros((0, width))
        near = np.argsort(-(flat @ centers.T), axis=1, kind="stable")[:, :probes]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, LIST])


def _with_lists(rows: DataFrame, vector: str, centers: np.ndarray, probes: int) -> DataFrame:
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{LIST} array<int>"])
    at = rows.columns.index(vector)
    rows = rows.filter(F.size(vector) == centers.shape[1])
    return rows.mapInArrow(lambda b: _nearest_lists(b, at, centers, probes), kinds)


class VectorIndex:
    """A stored index: `path`/lists/_list=n holds the rows of list n, `path`/centroids the centers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy(LIST).collect()  # a row a list
        self.centers = np.array([r["center"] for r in rows]) if rows else np.zeros((0, 0))
        self.stored = spark.read.parquet(f"{path}/lists") if rows else None

    @classmethod
    def build(cls, rows: DataFrame, key: str, vector: str, path: str, lists: int = LISTS, sample: int = SAMPLE) -> VectorIndex:
        """Trains on a sample and stores every row of rows."""
        spark, centers = rows.sparkSession, centroids(rows, key, vector, lists, sample)
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], f"{LIST} int, center array<double>").write.parquet(f"{path}/centroids")
        if len(centers):
            placed = _with_lists(_units(rows.withColumn("_unit", F.col(vector)), "_unit"), "_unit", centers, 1).withColumn(LIST, F.col(LIST)[0]).drop("_unit")
            placed.repartition(F.col(LIST), F.pmod(F.xxhash64(key), F.lit(max(1, rows.count() // (FILE_ROWS * len(centers)))))).write.partitionBy(LIST).parquet(f"{path}/lists")
        return cls(spark, path)

    def probed(self, queries: DataFrame, probes: int | None = PROBES) -> tuple[DataFrame, DataFrame]:
        """The stored rows of the lists that are asked, and the queries once for each of theirs. None: all lists."""
        probes = len(self.centers) if probes is None else min(probes, len(self.centers))
        asked = _units(queries.withColumn("_unit", F.col("query")), "_unit")
        asked = _with_lists(asked, "_unit", self.centers, probes).drop("_unit").withColumn(LIST, F.explode(LIST))
        if probes == len(self.centers):
            return self.stored, asked
        wanted = [r[LIST] for r in asked.select(LIST).distinct().collect()]  # lists at most
        return self.stored.filter(F.col(LIST).isin(wanted)), asked

    def search(self, key: str, vector: str, queries: DataFrame, k: int, on: dict[str, str] | None = None, probes: int | None = PROBES) -> DataFrame:
        """query_id, key, rank, similarity of the k nearest rows in each query's scope, among its nearest lists. `probes` None: exact.

        queries: query_id, query and scope columns, as for vector_topk.
        """
        if self.stored is None:
            kinds = dict(queries.dtypes)
            return self.spark.createDataFrame([], f"query_id {kinds['query_id']}, `{key}` long, similarity double, rank int")
        rows, asked = self.probed(queries, probes)
        return vector_topk(rows, key, vector, asked, k, {**(on or {}), LIST: LIST})


    def probes_for(self, key: str, vector: str, queries: DataFrame, k: int, target: float = 0.95, on: dict[str, str] | None = None) -> int:
        """The least number of probes by which these queries find a share `target` of their exact hits: a quantile of the places of the hits' lists."""
        exact = self.search(key, vector, queries, k, on, None).select("query_id", key)
        homes = exact.join(self.stored.select(key, F.col(LIST).alias("_home")), key)
        asked = _with_lists(_units(queries, "query"), "query", self.centers, len(self.centers)).select("query_id", LIST)
        places = homes.join(asked, "query_id").select(F.array_position(LIST, F.col("_home")).alias("p"))
        found = places.agg(F.expr(f"percentile_disc({target}) WITHIN GROUP (ORDER BY p)")).first()[0]
        return int(found or 1)


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """The share of the exact hits that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return both.agg(F.count("hit") / F.count(F.lit(1))).first()[0]

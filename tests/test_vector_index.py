"""The inverted file: exact by parameter, pruned by lists, measured recall, hot lists and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import search
from corpusmill.operators.vector_index import LIST, VectorIndex, recall

KIND = "vec_id long, v array<float>, scope int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    made = [(i, [float(x) for x in centers[i % 30] + rng.normal(scale=0.3, size=16)], i % 3) for i in range(1500)]
    made += [(2000 + i, made[7][1], 1) for i in range(400)]  # one vector held by a fifth of the rows
    made += [(9000, [0.0] * 16, 0), (9001, None, 0), (9002, [1.0] * 4, 0)]
    return spark.createDataFrame(made, KIND).repartition(4).cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return VectorIndex.build(rows, "vec_id", "v", str(tmp_path_factory.mktemp("index")), lists=30)


def asked(rows, rest: int = 11):
    return rows.filter(f"vec_id % 50 = {rest} and vec_id < 1500").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), "scope")


def test_all_lists_are_exact(rows, index):
    plain = search.vector_topk(rows.filter("vec_id < 9000"), "vec_id", "v", asked(rows), 10, {"scope": "scope"})
    found = index.search("vec_id", "v", asked(rows), 10, {"scope": "scope"}, None)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_every_row_is_stored_once(rows, index):
    ids = [r["vec_id"] for r in index.stored.select("vec_id").collect()]
    assert sorted(ids) == sorted(r["vec_id"] for r in rows.filter("vec_id < 9000").collect())


def test_recall_and_probes(rows, index):
    exact = index.search("vec_id", "v", asked(rows), 10, None, None)
    probes = index.probes_for("vec_id", "v", asked(rows, 25), 10)
    found = index.search("vec_id", "v", asked(rows), 10, None, probes)
    assert probes < 10 and recall(found, exact, "vec_id") >= 0.9
    assert recall(exact, exact, "vec_id") == 1


def test_other_lists_are_not_read(rows, index):
    found = index.search("vec_id", "v", asked(rows).limit(1), 5, None, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{LIST}" in plan.replace("#", " #").replace(f"{LIST} #", f"{LIST}#") or f"[{LIST}#" in plan
    stored, _ = index.probed(asked(rows).limit(1), 2)
    assert stored.select(LIST).distinct().count() == 2


def test_without_rows_or_queries(spark, rows, index, tmp_path):
    assert index.search("vec_id", "v", asked(rows).limit(0), 5).count() == 0
    none = VectorIndex.build(rows.limit(0), "vec_id", "v", str(tmp_path / "none"))
    assert none.search("vec_id", "v", asked(rows), 5).count() == 0


def test_recall_on_the_tables(spark):
    from corpusmill.plans import catalog

    found = catalog.queries()["vector_index_topk"](spark, "/root/testdata/sf0.01")
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.lit(1).alias("all"))
    exact = search.vector_topk(rows.withColumn("all", F.lit(1)), "vec_id", "embedding", queries, 10, {"all": "all"})
    assert recall(found, exact, "vec_id") >= 0.9


def test_mapping_by_vectors_first(spark):
    vector = spark.createDataFrame([(1, 10, 0.9), (2, 11, 0.1), (4, 13, 0.5)], "query_id long, hit long, similarity double")
    keyword = spark.createDataFrame([(1, 20), (2, 21), (3, 22)], "query_id long, hit long")
    found = search.auto_mapped(vector, keyword, spark.createDataFrame([(3,), (3,)], "finding long"))
    rows = {r["finding"]: (r["branch"], r["clause"], r["relevance_pct"], r["inserted"]) for r in found.collect()}
    assert rows == {1: ("vector", 10, 90, True), 2: ("keyword", 21, 58, True), 3: ("keyword", 22, 58, False), 4: ("vector", 13, 50, True)}

"""Every query against its SQL on the smallest tables, as sorted rows of equal columns."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from corpusmill.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == columns
    order = [[d[0] for d in found.description].index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert ours == theirs
    assert ours, "nothing found"


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0

"""What later findings named: work that grew faster than the input, and differences from SQL on larger tables."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import models
from corpusmill.functions import text as tx
from corpusmill.operators import composites, search, sections
from corpusmill.plans import catalog
from corpusmill.session import BATCH


def test_word_pairs_find_the_words_once(spark):
    rows = spark.createDataFrame([("alpha beta with gamma alpha beta delta " + "omega " * 5,), ("one",), ("alpha",), (None,)], "text string").select(tx.key_bigrams(F.coalesce("text", F.lit(""))).alias("p"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r["p"] for r in rows.collect()] == [["alpha beta", "beta gamma", "gamma alpha", "beta delta"], [], [], []]


TRIMMED = ["merge_by_quality", "quality_gate", "repair_titles", "title_rules"]


@pytest.mark.parametrize("name", TRIMMED)
def test_ends_are_trimmed_as_the_sql_trims_them(spark, tmp_path, name):
    """DuckDB reads \\v in the SQL's white space as the letter v: titles and bodies lose it at both ends."""
    texts = ["Wort und Wiv\nmehr v", "v Über alles vv", "vanish", " v ", "Sound v\tv", "", None]
    rows = [(i, t, ["de", "en", "es"][i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(told, key=repr)


def test_many_queries_meet_the_rows_in_blocks(spark, monkeypatch):
    """Blocks of a few rows and queries give what stated queries give; copies of one vector don't make pairs beyond k a block."""
    made = [(i, [float(i * 7 % 11), float(i % 5), 1.0 + i % 3], i % 2) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0], 0) for i in range(200)] + [(900, [0.0] * 3, 0), (901, [1.0], 1), (902, None, 1)]
    rows = spark.createDataFrame(made, "vec_id long, v array<float>, scope int")
    queries = rows.filter("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "v AS query", "cast(scope AS long) AS scope")
    stated = search.vector_topk(rows, "vec_id", "v", queries, 4, {"scope": "scope"})
    monkeypatch.setattr(search, "ROW_BLOCK", 50)
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    found = search.vector_topk(rows, "vec_id", "v", queries, 4, {"scope": "scope"}, limit=0)
    assert "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stated.collect()))


def test_sections_are_read_once(spark):
    """Ancestors and roll-up take their input in one pass, keep repeated rows and know null scopes."""
    rows = spark.createDataFrame([(1, "1.2.3", "t", "b", 5), (1, "1.2.3", "u", "c", 5), (1, "1", "top", "x", 1), (None, "2.1", "n", " ", 7)], "doc int, clause_id string, title string, body string, sort_order long")
    told = sections.rolled_up(sections.with_ancestors(rows, ["doc"]), ["doc"])
    assert told._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted(map(tuple, told.collect()), key=repr) == sorted([
        (1, "1", "top", "x", 1), (1, "1.2", "Clause 1.2", "1.2.3 t\n\nb\n\n1.2.3 u\n\nc", 102000000), (1, "1.2.3", "t", "b", 5), (1, "1.2.3", "u", "c", 5),
        (None, "2", "Clause 2", "2.1 n\n\nn", 200000000), (None, "2.1", "n", " ", 7)], key=repr)


def test_texts_go_to_python_in_small_batches(spark):
    spark.conf.unset(BATCH)
    models.caller(lambda texts: texts)
    assert spark.conf.get(BATCH) == "1000"
    spark.conf.unset(BATCH)
    search.keyword_hits(spark.createDataFrame([("a",)], "t string"), "t", spark.createDataFrame([(1, "castle")], "query_id long, query string"))
    assert spark.conf.get(BATCH) == "1000"


def test_sections_are_translated_in_their_rows(spark):
    """One pass without joins; rows of one key and rows without a key keep their own texts."""
    long = "\n\n".join(f"Paragraph {i} of words. " * 3 for i in range(9))
    made = [(1, "1", "a", "one\n\ntwo"), (1, "1", "b", "three"), (None, "2", "c", "four"), (None, "2", None, None), (2, "3", "d", long), (3, "4", "e", long.replace("Paragraph 5", "CUT paragraph 5"))]

    def backend(texts):
        return [t[:9] if "CUT" in t else t.upper() for t in texts]

    rows = spark.createDataFrame(made, "k int, clause_id string, title string, body string")
    found = composites.translated(rows, ["k"], backend, "en", "fr", most=90, wait=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate [" not in plan and plan.count("LogicalRDD") == 1
    told = [(r["k"], r["title"], r["body"], r["error"]) for r in found.collect()]
    whole = "\n\n".join(p.strip() for p in long.upper().split("\n\n"))
    assert told == [(1, "A", "ONE\n\nTWO", None), (1, "B", "THREE", None), (None, "C", "FOUR", None), (None, None, "", None), (2, "D", whole, None), (3, None, None, "part 6: too short")]


def test_ends_and_short_texts_are_told_without_scans(spark):
    odd = " \t\n\x0b\x0c\r    ​　 \u0085ab"
    rng = random.Random(8)
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(a, b) for a, b in zip(texts, reversed(texts), strict=True)] + [(None, "a"), ("a", None)], "a string, b string")
    white = rf"[{re.sub('[^ -~]', '', tx.WHITE).replace('-', '')}  - 　]"
    for r in rows.select("a", "b", tx.strip(F.col("a")).alias("s"), tx.too_short(F.col("a"), F.col("b"), 0.7, 2).alias("short")).collect():
        assert r["s"] == (r["a"] if r["a"] is None else re.sub(rf"\A{white}+|{white}+\Z", "", r["a"], flags=re.ASCII))
        dense = [len(re.sub(r"\s+", "", t or "", flags=re.ASCII)) for t in (r["a"], r["b"])]
        assert r["short"] == (dense[0] >= 2 and dense[1] < 0.7 * dense[0])

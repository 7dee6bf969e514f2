"""Operators that the tables can't show: sections, state, sources, seams and streams on small fixtures."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import data, ids
from corpusmill.functions import models
from corpusmill.functions import text as tx
from corpusmill.operators import chunks, metrics, quality, search, sections, state
from corpusmill.sources import docx, sinks, tables
from corpusmill.streaming import jobs


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "key"), [("4.1", 401000000), ("10.1", 1001000000), ("4.1.2", 401020000), ("", 0), ("A.1", 100000000)])
def test_sort_keys(spark, raw, key):
    assert one(spark, raw, ids.sort_key) == key


def test_ids(spark):
    assert one(spark, " 04.01. ", ids.normal_id) == "4.1"
    assert one(spark, "A.1 ", ids.normal_id) == "A.1"
    assert one(spark, "4.1.2", ids.ancestor_ids) == ["4", "4.1"] and one(spark, "4", ids.ancestor_ids) == []
    assert one(spark, "iso 9001-x", ids.standard_id) == "ISO9001X"


def test_chunks_keep_the_redundant_tail(spark):
    df = spark.createDataFrame([(1, "x" * 2100), (2, ""), (3, None)], "id int, text string")
    assert [(r["id"], r["chunk_index"], len(r["content"])) for r in chunks.chunk(df).orderBy("id", "chunk_index").collect()] == [(1, 0, 1200), (1, 1, 1100), (1, 2, 100), (2, 0, 0), (3, 0, 0)]


TEXT = "noise before\n4 Context\n\n4.1 Understanding\nThe first body.\n(c) ISO 2015 All rights reserved\n4.2\nNeeds of parties\nSecond body.\n000 Quality notes 12\n5 Leadership\n5.1 Leadership and commitment\nTop management leads.\n4.1 Again\nlater body"


def test_sections(spark):
    found = sections.parse(spark.createDataFrame([(1, TEXT)], "doc_id int, text string"))
    rows = {r["clause_id"]: r for r in sections.first_wins(found, ["doc_id"]).collect()}
    assert set(rows) >= {"4", "4.1", "4.2", "5", "5.1"}
    assert rows["4.1"]["title"] == "Understanding" and rows["4.1"]["n_warnings"] == 1
    assert rows["4.2"]["title"] == "Needs of parties" and "Second body." in rows["4.2"]["body"]
    whole = sections.rolled_up(sections.with_ancestors(sections.first_wins(found, ["doc_id"]), ["doc_id"]), ["doc_id"])
    assert "Top management leads." in {r["clause_id"]: r["body"] for r in whole.collect()}["5"]


def test_missing_parents(spark):
    df = spark.createDataFrame([(1, "7.1.2", "t", "b", 1)], "doc_id int, clause_id string, title string, body string, sort_order long")
    assert {r["clause_id"]: r["title"] for r in sections.with_ancestors(df, ["doc_id"]).collect()} == {"7": "Clause 7", "7.1": "Clause 7.1", "7.1.2": "t"}


def test_titles(spark):
    assert one(spark, "Figure 3 shows", tx.bad_title) and one(spark, "", tx.bad_title) and not one(spark, "Leadership and commitment", tx.bad_title)
    assert one(spark, "Scope of the organization shall be determined", tx.title_of) == "Scope of the organization"


def test_state(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, e string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, v string, e string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(state.upsert(old, new, ["k"])) == [(1, "a", "x"), (2, "c", None), (3, "d", "z")]
    assert rows(state.upsert_columns(old, new, ["k"], ["v", "e"])) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "z")]
    assert rows(state.insert_ignore(old, new, ["k"])) == [(3, "d", "z")]
    kept, gone = state.split_deleted(old, F.col("v") == "a")
    assert rows(kept) == [(2, "b", "y")] and rows(gone) == [(1, "a", "x")]


def test_json(spark):
    assert one(spark, 'say {"a": 1} so', data.first_object) == '{"a": 1}' and one(spark, '{"a": 1', data.first_object) is None
    assert one(spark, "[1]", data.tolerant_map) == {}


def test_scores(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (0.96,)], "x double").select(data.score(F.col("x")).alias("s"), data.relevance(F.col("x")).alias("r"))
    assert [tuple(r) for r in df.collect()] == [(2, 50), (4, 50), (10, 95)]


def test_search_scope(spark):
    rows = spark.createDataFrame([(1, "iso-standards-A1", "A1", "en"), (2, "iso-standards", "A1", "en"), (3, "iso-standards", "B2", "en"), (4, "iso-standards-A1", "A1", "he")], "id int, c string, s string, l string")
    assert [r["id"] for r in rows.filter(search.in_scope(F.col("c"), F.col("s"), F.col("l"), "A1", "en")).orderBy("id").collect()] == [1, 2]


def test_vector_search_both_ways(spark, monkeypatch):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(300, 8))
    vectors[40:60] = vectors[7]  # ties
    vectors[70] = 0
    rows = [(i, v.tolist(), f"s{i % 3}" if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [(300, None, "s1"), (301, [1.0, 2.0], "s1"), (302, [1.0, None, *[0.0] * 6], "s1"), (303, [], "s1")]
    df = spark.createDataFrame(rows, "id long, v array<double>, s string").repartition(4)
    queries = df.filter("id % 7 = 0").select(F.col("id").cast("int").alias("query_id"), F.col("v").alias("query"), F.col("s").alias("scope"))
    monkeypatch.setattr(search, "CELLS", 64)  # few queries at once
    met = search.vector_topk(df, "id", "v", queries, 4, {"s": "scope"})
    assert dict(met.dtypes) == {"query_id": "int", "id": "bigint", "similarity": "double", "rank": "int"}
    by_matrix = {(r["query_id"], r["rank"]): (r["id"], round(r["similarity"], 9)) for r in met.collect()}
    by_join = {(r["query_id"], r["rank"]): (r["id"], round(r["similarity"], 9)) for r in search.vector_topk(df, "id", "v", queries, 4, {"s": "scope"}, limit=0).collect()}
    whole = {r[0]: (np.array(r[1]), r[2]) for r in rows if r[1] and len(r[1]) in (2, 8) and None not in r[1] and any(r[1]) and r[2]}
    told = {}
    for q in (i for i in whole if i % 7 == 0):
        v, scope = whole[q]
        near = [(-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), i) for i, (w, s) in whole.items() if s == scope and len(w) == len(v)]
        near = sorted((round(x, 12), i) for x, i in near)[:4]
        told |= {(q, n): (i, round(-x, 9)) for n, (x, i) in enumerate(near, 1)}
    assert by_matrix == by_join == told
    assert search.vector_topk(df, "id", "v", queries.filter("false"), 4, {"s": "scope"}).count() == 0


def test_plans_combine_before_the_shuffle(spark, capsys):
    docs = spark.createDataFrame([(1, "onth station")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "station master")], "query_id long, query string")
    search.keyword_topk(docs, "doc_id", "text", queries).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    quality.body_counts(docs, ["doc_id"], F.col("text")).explain()
    assert "partial_count" in capsys.readouterr().out


def test_increase_over_a_restart(spark):
    rows = [(i, f"2024-01-01 {i:02d}:00:00", "s", v) for i, v in enumerate([1, 5, 9, 2, 3, 3, 10, 1])]
    df = spark.createDataFrame(rows, "event_id int, ts string, k string, value long").withColumn("ts", F.col("ts").cast("timestamp"))
    for span in ("1 hour", "3 hours", "30 days"):
        assert metrics.increase(df, ["k"], span=span).first()["increase"] == 8 + 2 + 1 + 7 + 1


def test_payloads(spark):
    df = spark.createDataFrame([('[{"clause_id": "1", "title": "t", "text": "b"}]',), ('{"standard": "S", "clauses": [{"clause_id": "2", "title": "u", "body": "c", "sort_order": 3}]}',)], "payload string")
    assert sorted(map(tuple, tables.clause_payloads(df, "D").collect())) == [("D", "1", "t", "b", None), ("S", "2", "u", "c", 3)]
    both = '[{"standard": "S", "clause_id": "4", "sort_order": 1, "en": {"title": "E", "body": "e"}, "he": {"title": "H", "body": "h"}}]'
    two = spark.createDataFrame([(both,)], "payload string")
    assert {r["language"]: r["title"] for r in tables.bilingual_payloads(two).collect()} == {"en": "E", "he": "H"}
    assert one(spark, both, tables.is_bilingual) and not one(spark, "[]", tables.is_bilingual)


def test_seed_folder(spark, tmp_path):
    (tmp_path / "root/std/deep").mkdir(parents=True)
    (tmp_path / "root/std/ISO9001-2015-he.md").write_text("שלום עולם")
    (tmp_path / "root/std/deep/x.bin").write_bytes(b"\x00\x01")
    (tmp_path / "root/std/.gitkeep").write_text("")
    (tmp_path / "manifest.yaml").write_text("collections:\n  - id: iso\n    path: std\n    languages: [en, he]\n    standards: [ISO9001]\n    ingest: {chunk_size: 5, chunk_overlap: 1}\n")
    texts = tables.file_texts(tables.files(spark, str(tmp_path / "root")))
    assert {r["name"]: r["status"] for r in texts.collect()} == {"ISO9001-2015-he.md": "ok", "x.bin": "binary"}
    rows = tables.seed_rows(texts, tables.manifest(spark, str(tmp_path / "manifest.yaml")))
    r = rows.first()
    assert (r["collection_id"], r["language"], r["standard"], r["edition"]) == ("iso", "he", "ISO9001", "2015")
    cut = chunks.chunk(rows.select("collection_id", "text", "chunk_size", "chunk_overlap"), "text", F.col("chunk_size"), F.col("chunk_overlap"))
    assert cut.count() == 3


def test_docx(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda s, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{s}</w:t></w:r></w:p>"
    head = p("Scope", '<w:pStyle w:val="Heading1"/>')
    xml = f"<w:document {ns}><w:body>{head}{p('Body.')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    df = spark.createDataFrame([("p", "docx", bytearray(raw.getvalue())), ("q", "docx", bytearray(b"no"))], "path string, kind string, content binary")
    assert {r["path"]: r["text"] for r in docx.docx_texts(df).collect()} == {"p": "## Scope\nBody.\na | b", "q": ""}


def test_exposition(spark):
    df = spark.createDataFrame([("calls", 'a"b\\', 2)], "metric string, model string, value int")
    assert sinks.exposition(df, ["model"]).first()["line"] == 'calls{model="a\\"b\\\\"} 2'


def test_seams(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        raise OSError

    assert models.tried(flaky, ["a", "b"], None, wait=0) == [None, None] and calls == [2, 2, 2]
    df = spark.createDataFrame([("a b",), (None,)], "x string").select(models.embedder()(F.col("x")).alias("v")).select(data.is_failed_embedding(F.col("v")).alias("bad"), data.norm(F.col("v")).alias("n"))
    assert round(df.first()["n"], 5) == 1.0
    upper = models.transformer(lambda texts: [t.upper() for t in texts])
    assert spark.createDataFrame([("a",)], "x string").select(upper(F.col("x")).alias("y")).first()["y"] == "A"


def test_counter_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), rows.schema, 10)
    q = jobs.counter_windows(jobs.distinct_events(stream), None).writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    late = rows.agg(F.max("ts")).first()[0]
    found = {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    own = {(r["start"], r["event_type"]): r["n"] for r in rows.groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found and all(own[k] == n for k, n in found.items()) and max(k[0] for k in found) < late

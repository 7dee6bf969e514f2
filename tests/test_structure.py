"""Extracted structure, titles, Hebrew, replies and composites on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import models, replies
from corpusmill.functions import text as tx
from corpusmill.operators import composites, sections, state, structure, viewer
from corpusmill.sources import docx, sinks, tables


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("title", "fits"),
    [("Scope.", True), ("Records of changes", False), ("Introduction", True), ("monitoring of it", False), ("It shall hold", False), ("a,", False), ("Ends;", False), ("סעיף", False), ("כללי", True), ("ראשון,", True), ("x" * 121, False), ("", False), ("12 3", False)],
)
def test_title_like(spark, title, fits):
    assert one(spark, title, tx.title_like) is fits


def test_split_words_are_joined_in_one_scan(spark):
    assert one(spark, "the abcd efgh", tx.repaired_words) == "the abcd efgh"
    assert one(spark, "man agement of qual ity and sys tems", tx.repaired_words) == "management of qual ity and systems"


def test_hebrew_lines_are_used_once(spark):
    assert one(spark, "ב\nקרה\nה\nארגון", tx.rejoined_lines) == "בקרה\nהארגון"
    assert one(spark, "ב\nקרה\n5.1", tx.rejoined_lines) == "בקרה\n5.1"
    assert one(spark, "ניהו\nל\nאיכות", tx.rejoined_lines) == "ניהול\nאיכות"


def test_hebrew_spacing(spark):
    assert one(spark, "ה א ר ג ו ן של ב קרה על כל", tx.hebrew_spacing) == "הארגון של בקרה על כל"
    assert one(spark, "plain  text", tx.hebrew_spacing) == "plain  text"


def test_hebrew_bodies(spark):
    assert "אימוץ מערכת ניהול" in one(spark, "אימוץ\n\nמערכת\n\nניהול", tx.hebrew_body)
    assert one(spark, "left alone\n\nx", tx.hebrew_body) == "left alone\n\nx"


def test_pages_from_word_boxes(spark):
    words = [("p", 1, 2, 5.0, 20.0, "ניהול"), ("p", 1, 2, 9.0, 20.0, "מערכת"), ("p", 1, 2, 1.0, 20.0, "4.1"), ("p", 1, 1, 1.0, 10.0, "Plain"), ("p", 1, 1, 2.0, 10.0, "line"), ("p", 2, 1, 0.0, 30.0, "end"), ("p", 2, 1, 0.0, 30.0, " ")]
    df = spark.createDataFrame(words, "page string, block int, line int, x double, y double, word string")
    assert viewer.page_lines(df, ["page"]).first()["text"] == "Plain line\n4.1 מערכת ניהול\n\nend"


def test_sparse_pages(spark):
    assert one(spark, "4.1 Context\nshall be there", tx.sparse_page) and not one(spark, "no numbers", tx.sparse_page)
    df = spark.createDataFrame([("4.1 x", "4.1 x and much more text"), ("plain", "other, longer text")], "a string, b string")
    assert [r["t"] for r in df.select(tx.page_text(F.col("a"), F.col("b")).alias("t")).collect()] == ["4.1 x and much more text", "plain"]


def logical(spark, text):
    rows = structure.reflowed(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", F.col("text"))
    return [r["line"] for r in rows.orderBy("line_no").collect()]


def test_reflow(spark):
    assert logical(spark, "4.1\nUnderstanding the organization\nwrapped lines\nso on") == ["4.1 Understanding the organization", "wrapped lines so on"]
    assert logical(spark, "5.1.2\n....\n. Customer focus\nBody of it.") == ["5.1.2 Customer focus", "Body of it."]
    assert logical(spark, "7.2\nand what follows is body text of some length, not a title.") == ["7.2 Clause 7.2", "and what follows is body text of some length, not a title."]
    assert logical(spark, "# Marked title\n6.1\nBody comes after the heading was found, at length.") == ["6.1 Marked title", "Body comes after the heading was found, at length."]
    assert logical(spark, "word of the manag\nement system\nAll rights reserved\nNext paragraph, which is not wrapped and quite long.") == ["word of the manag ement system", "Next paragraph, which is not wrapped and quite long."]
    assert logical(spark, "split the man\nagement") == ["split the management"]


def test_titles_before_ids(spark):
    text = "5.1 מנהיגות ומחויבות\nההנהלה הבכירה תפגין מנהיגות.\nכללי\n.5.1.1\nההנהלה הבכירה תהיה אחראית.\nהתמקדות בלקוח\n.5.1.2\nדרישות הלקוח ייקבעו."
    found = sections.parse(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    by = {r["clause_id"]: r for r in sections.first_wins(found, ["doc_id"]).collect()}
    assert set(by) == {"5.1", "5.1.1", "5.1.2"}
    assert "כללי" in by["5.1.1"]["title"] and "אחראית" in by["5.1.1"]["body"] and "התמקדות" in by["5.1.2"]["title"]


def test_nested_headings_are_promoted(spark):
    body = "Top management shall demonstrate leadership.\n5.1.1 General\nTop management shall be accountable.\nCustomer focus\n.5.1.2\nCustomer requirements shall be determined."
    df = spark.createDataFrame([(1, "5.1", "Leadership", body, 501000000), (1, "6", "Planning", "", 600000000)], "doc_id int, clause_id string, title string, body string, sort_order long")
    by = {r["clause_id"]: (r["title"], r["body"]) for r in structure.promoted(df, ["doc_id"]).collect()}
    assert by == {
        "5.1": ("Leadership", "Top management shall demonstrate leadership."),
        "5.1.1": ("General", "Top management shall be accountable."),
        "5.1.2": ("Customer focus", "Customer requirements shall be determined."),
        "6": ("Planning", ""),
    }


def test_titles_are_repaired_by_the_own_dictionary(spark):
    rows = [("1", "גיליון התיקון מס '"), ("4", "4 ההקשרשל"), ("6", "אזכורים נורמטיביים"), ("8.3", "ומחויבות"), ("9", "הערכת ביצועים"), ("7.1", "7.1 - משאבים")]
    df = spark.createDataFrame([(i, t, "body", 0) for i, t in rows], "clause_id string, title string, body string, sort_order long")
    known = spark.createDataFrame([("1", "היקף"), ("4", "הקשר הארגון"), ("6", "תכנון"), ("9", "הערכת ביצועים")], "clause_id string, canonical string")
    by = {r["clause_id"]: r["title"] for r in structure.with_repaired_titles(df, known, "he").collect()}
    assert by == {"1": "היקף", "4": "הקשר הארגון", "6": "תכנון", "8.3": "סעיף 8.3", "9": "הערכת ביצועים", "7.1": "משאבים"}


def test_foreign_titles_are_never_kept(spark):
    df = spark.createDataFrame([("7", "Support", "b", 0), ("7.1", "Resources", "b", 0), ("8", "Own Support", "b", 0), ("9", "Product realization", "b", 0)], "clause_id string, title string, body string, sort_order long")
    none = spark.createDataFrame([], "clause_id string, canonical string")
    by = {r["clause_id"]: r["title"] for r in structure.with_repaired_titles(df, none, "en", ["Support", "Resources"], ["Own Support"]).collect()}
    assert by == {"7": "Clause 7", "7.1": "Clause 7.1", "8": "Own Support", "9": "Product realization"}


def gate(spark, change=None, hebrew=False):
    rows = [["0", "Introduction", "x" * 200], ["1", "Scope", "x" * 200], ["4", "Context", "x" * 200], ["4.1", "Understanding", "x" * 200]]
    rows += [[f"{a}.{b}", "Sound title", "x" * 200] for a in range(5, 10) for b in range(1, 6)] + [[f"8.{a}.1", "Sound title", "x" * 200] for a in range(1, 13)]
    for r in rows:
        if change:
            change(r)
    known = spark.createDataFrame([("1", "Scope"), ("4", "Context of it")], "clause_id string, canonical string")
    return structure.structure_gate(spark.createDataFrame([(1, *r) for r in rows], "doc_id int, clause_id string, title string, body string"), ["doc_id"], known, hebrew).first()


def test_structure_gate(spark):
    assert gate(spark)["ok"] and gate(spark)["n_core"] == 41 and gate(spark)["n_level3"] == 12

    def changes(**of):
        def change(r):
            for clause, (place, value) in of.items():
                if r[0].startswith(clause.replace("_", ".")[1:]):
                    r[place] = value

        return change

    for change in (changes(c8_1=(0, "8.9")), changes(c8=(1, "Clause 8")), changes(c0=(0, "3")), changes(c4_1=(1, "")), changes(c1=(1, "Other words")), changes(c=(2, "x"))):
        assert not gate(spark, change)["ok"]


def test_sets_merge_by_quality(spark):
    rows = [(0, "04.1", "Clause 4.1", "long " * 30), (1, "4.1", "Context", "short"), (2, "4.1", "Clause 4.1", "longer " * 100), (0, "5", "", "a body"), (1, "5", "Leadership", "")]
    df = spark.createDataFrame(rows, "set int, clause_id string, title string, body string")
    assert {r["clause_id"]: (r["title"], r["body"]) for r in structure.merged_by_quality(df, []).collect()} == {"4.1": ("Context", "short"), "5": ("Leadership", "a body")}


def test_segments_merge(spark):
    rows = [(0, 0, "4.1", "", "one"), (0, 1, "x", "junk", ""), (1, 0, "4.01", "Context", "one"), (1, 1, "4.1", "Later", "two"), (2, 0, "11", "Beyond", "b")]
    df = spark.createDataFrame(rows, "segment int, n int, clause_id string, title string, body string")
    assert [(r["clause_id"], r["title"], r["body"]) for r in structure.merged_segments(df, [], ["segment", "n"]).collect()] == [("4.1", "Context", "one\n\ntwo")]


def test_styles_number_sections(spark):
    rows = [(1, 0, 2, "Too early"), (1, 1, 1, "First"), (1, 2, None, "text"), (1, 3, 2, "Below"), (1, 4, 3, "Deep"), (1, 5, None, "more"), (1, 6, 1, "Second"), (1, 7, 3, "Skipped"), (1, 8, None, "tail")]
    df = spark.createDataFrame(rows, "path int, pos long, level int, text string")
    assert [(r["clause_id"], r["title"], r["body"]) for r in structure.by_style(df, "path").orderBy("sort_order").collect()] == [("1", "First", "text"), ("1.1", "Below", ""), ("1.1.1", "Deep", "more"), ("2", "Second", "tail")]
    told = spark.createDataFrame([(1, 0, None, "before"), (1, 1, None, "4.1 Context The organization shall act"), (1, 2, None, "Body"), (1, 3, None, "4.2 Needs")], "path int, pos long, level int, text string")
    assert [(r["clause_id"], r["title"], r["body"]) for r in structure.faithful(told, "path").orderBy("sort_order").collect()] == [("4.1", "Context", "The organization shall act\n\nBody"), ("4.2", "Needs", "")]


@pytest.mark.parametrize(
    ("reply", "ids"),
    [
        ('{"result": {"clauses": [{"clause_id": "4.1", "title": "t", "body": "b"}, [{"clause_id": "4.2", "title": "", "body": ""}]]}, "meta": {"n": 1}}', ["4.1", "4.2"]),
        ('```json\n[{"clause_id": "5", "title": "t", "body": "b"}]\n```', ["5"]),
        ('{"clauses": [{"clause_id": "6", "title": "t", "body": "b"},', ["6"]),
        ('noise [{"clause_id": "7", "title": "t", "body": "b"}', ["7"]),
        ("not json", None),
        (None, None),
        ('{"a": 1}', []),
    ],
)
def test_replies(spark, reply, ids):
    found = one(spark, reply, replies.clauses())
    assert (None if found is None else [x["clause_id"] for x in found]) == ids


def test_wrapped_replies():
    item = {"clause_id": "1"}
    assert replies.wrapped({"items": [item]}) == replies.wrapped([item]) == replies.wrapped({"1": item}) == [item] and replies.wrapped({"a": 1}) == []


def test_bodies_are_packed_and_texts_segmented(spark):
    assert one(spark, "a" * 20 + "\n\n" + "b" * 20 + "\n\n" + "c" * 5, lambda c: tx.packed(c, 30)) == ["a" * 20, "b" * 20 + "\n\n" + "c" * 5]
    assert one(spark, "One. " * 10, lambda c: tx.packed(c, 12)) == ["One. One."] * 5
    assert one(spark, None, tx.packed) == [""]
    text = "preamble\n4 Context\n" + "x" * 10 + "\n5 Leadership\n" + "y" * 40
    assert one(spark, text, lambda c: tx.segments(c, 30, 10)) == ["preamble", "4 Context\n" + "x" * 10 + "\n", ("5 Leadership\n" + "y" * 40)[:30], ("5 Leadership\n" + "y" * 40)[20:50], ("5 Leadership\n" + "y" * 40)[40:]]
    assert one(spark, text, lambda c: tx.segments(c, 30, 10, 200))[0].startswith("4 Context")


def test_translation_is_complete_or_an_error(spark):
    def backend(texts):
        return ["" if "EMPTY" in t else t[: len(t) // 3] if "CUT" in t else t.upper() for t in texts]

    rows = [("1", "scope", "para one\n\npara two"), ("2", "none", ""), ("3", "cut", "CUT " * 30), ("4", "empty", "EMPTY part"), ("5", None, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, clause_id string, title string, body string")
    found = {r["clause_id"]: r for r in composites.translated(df, ["doc_id"], backend, "en", "xx", wait=0).collect()}
    assert (found["1"]["title"], found["1"]["body"], found["1"]["error"]) == ("SCOPE", "PARA ONE\n\nPARA TWO", None)
    assert found["2"]["body"] == "" and found["2"]["error"] is None
    assert found["3"]["error"] == "part 1: too short" and found["3"]["body"] is None and found["4"]["error"] == "part 1: empty"
    assert found["5"]["error"] is None


def test_extraction_leaves_failed_segments_out(spark):
    def backend(texts):
        return ["cut off" if "BAD" in t else f'[{{"clause_id": "{t.split()[0]}", "title": "T", "body": "{len(t)}"}}]' for t in texts]

    docs = spark.createDataFrame([(1, "4 Context\nabc\n5 Leadership BAD\nabc\n6 Planning\nabc"), (2, "BAD"), (3, None)], "doc_id int, text string")
    found, failed = composites.extracted(docs, "doc_id", "text", backend, most=20, overlap=5, wait=0)
    assert [(r["doc_id"], r["clause_id"]) for r in found.orderBy("sort_order").collect()] == [(1, "4"), (1, "6")]
    assert [tuple(r) for r in failed.collect()] == [(2, 1, 1)]


def test_calls_end_as_they_are_told(spark):
    waits = []

    def limited(texts):
        waits.append(1)
        raise models.RateLimited

    def refused(texts):
        raise models.ModelError

    assert models.answered(limited, ["a"], wait=0) == (None, "limited", 3) and len(waits) == 3
    assert models.answered(refused, ["a"], wait=0) == (None, "refused", 1)
    df = spark.createDataFrame([("m", "a"), ("m", "")], "model string, x string").withColumn("call", models.caller(lambda t: t)(F.col("x")))
    assert {(r["status"], r["n"], r["attempts"]) for r in models.call_log(df, ["model"]).collect()} == {("ok", 1, 1), ("empty", 1, 1)}
    assert models.model_of("parse", {"parse": "mine"}) == "mine" and models.model_of("parse") == models.MODELS["parse"]


def test_viewer_audit(spark):
    he = [("he", "0", "מבוא", "א " * 60, False), ("he", "5.1.1", "כללי", "x\n\n" * 5 + "word\n\n" * 40, True)]
    df = spark.createDataFrame([*he, ("en", "0", "Introduction", "x א", False)], "language string, clause_id string, title string, text string, fallback boolean")
    ok = {(r["language"], r["check"]): r["ok"] for r in viewer.viewer_audit(df).collect()}
    assert ok["he", "introduction_body"] and not ok["he", "fallbacks"] and not ok["he", "tokenised"] and not ok["en", "foreign_script"] and not ok["en", "sections"]


def test_maintenance(spark, tmp_path):
    assert state.with_defaults(spark.createDataFrame([(1,)], "k int")).filter("created_at is not null").count() == 1
    sheets = sinks.report(*(spark.createDataFrame([], s) for s in ("finding_id int, finding_text string", "finding_id int, clause_id string, clause_title string, relevance_pct int", "status string")))
    assert len(sinks.dated(sheets)["summary"].first()["report_date"]) == 10
    sinks.completed(spark.range(3), str(tmp_path / "done"))
    assert spark.read.text(str(tmp_path / "done")).first()[0] == "rows=3"
    sinks.save_report(sheets, str(tmp_path / "report"))
    files = spark.createDataFrame([("a", "pdf", bytearray(b"xyz"))], "name string, kind string, content binary")
    sinks.save_originals(files, str(tmp_path / "originals"))
    assert spark.read.parquet(str(tmp_path / "originals")).first()["size_bytes"] == 3
    assert one(spark, "aGk=", tables.base64_payload) == b"hi" and one(spark, "{{ a }} {{a}} {{b}}", tx.placeholders) == ["a", "b"]


def test_files_are_required_laid_out_and_marked(spark, tmp_path):
    (tmp_path / "std").mkdir()
    (tmp_path / "std/a.json").write_text('{"b":[1,2]}')
    (tmp_path / "std/b.docx").write_bytes(b"no such file")
    (tmp_path / "std/c.json").write_text("{cut")
    found = tables.files(spark, str(tmp_path))
    texts = {r["name"]: (r["status"], r["text"]) for r in tables.file_texts(found).collect()}
    assert texts["b.docx"][0] == "parse-error" and texts["c.json"] == ("ok", "{cut") and texts["a.json"][1].count("\n") >= 3
    collections = spark.createDataFrame([("here", "std", False), ("maybe", "none", True)], "id string, path string, optional boolean")
    tables.require(found, collections)
    with pytest.raises(FileNotFoundError, match="gone"):
        tables.require(found, collections.union(spark.createDataFrame([("gone", "nowhere", False)], collections.schema)))
    assert docx.docx_blocks(found).count() == 0


def test_repaired_corpus(spark):
    rows = [
        ("a", "1", "Scope", "What it is for."), ("a", "4", "Context", ""), ("a", "4.1", "and broken title,", "First.\n4.1.1 Inner needs\nSaid inside."), ("a", "4.2", "## marked", "gone"), ("a", "4.5", "Misplaced", "gone"),
        ("a", "0.1", "General", "Stays."), ("a", "0.6", "Too deep", "gone"), ("a", "7.1", "Correspondence between", "gone"), ("a", "8.1", "", ""), ("b", "9.1.2", "Satisfaction", "Said Above."),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, clause_id string, title string, body string, sort_order long")
    known = spark.createDataFrame([("4.1", "Understanding the organization"), ("9", "Performance evaluation")], "clause_id string, canonical string")
    found = {(r["source"], r["clause_id"]): (r["title"], r["body"]) for r in structure.repaired_corpus(df, ["source"], known, "en").collect()}
    assert found["a", "4.1"] == ("Understanding the organization", "First.") and found["a", "4.1.1"] == ("Inner needs", "Said inside.")
    assert found["a", "4"][0] == "Context" and "4.1" in found["a", "4"][1]  # empty: told by its children
    assert not {("a", c) for c in ("4.2", "4.5", "0.6", "7.1", "8.1")} & set(found) and found["a", "0.1"] == ("General", "Stays.")
    assert found["b", "9.1.2"] == ("Satisfaction", "Said Above.") and found["b", "9"][0] == "Performance evaluation"


def test_hebrew_audit(spark):
    rows = [("0", "מבוא", "א" * 60 + " " + "ב" * 60), ("0.1", "כללי", "x"), ("5.1.1", "כללי", "x"), ("5.1.2", "התמקדות בלקוח", "x"), ("6", "x" * 61, "ISO")]
    df = spark.createDataFrame([("he", *r, False) for r in rows], "language string, clause_id string, title string, text string, fallback boolean")
    ok = {r["check"]: r["ok"] for r in viewer.viewer_audit(df).collect()}
    assert all(ok[c] for c in ("first", "general_title", "leadership_title", "customer_title", "rejoined", "introduction_title", "fallbacks")) and not ok["body_titles"] and not ok["sections"] and "foreign_script" not in ok
    english = {r["check"] for r in viewer.viewer_audit(df.withColumn("language", F.lit("en"))).collect()}
    assert "foreign_script" in english and "general_title" not in english


def test_mixed_scripts(spark):
    rows = [("en", "Scope"), ("en", "Scope תחום"), ("he", "תחום Scope"), ("he", "ISO Standard תחום"), ("he", "תחום"), (None, "תחום Scope")]
    df = spark.createDataFrame([(*r, "s", str(i)) for i, r in enumerate(rows)], "language string, title string, standard string, clause_id string")
    assert sorted((r["clause_id"], r["issue"]) for r in viewer.mixed_script_titles(df).collect()) == [("1", "hebrew in en"), ("2", "latin in he")]


def test_deeply_nested_replies():
    item = {"clause_id": "1", "title": "t", "body": "b"}
    deep = item
    for i in range(5000):
        deep = [deep] if i % 2 else {"x": 1, "y": deep}
    assert list(replies.flattened(deep)) == [item]
    two = dict(item, clause_id="2")
    assert list(replies.flattened([{"a": [item], "b": {"clauses": two, "c": item}}, two, 3, None])) == [item, two, two]
    assert list(replies.flattened({"clauses": 3, "x": [item]})) == [item] and list(replies.flattened(dict(item, clauses=[two]))) == [two]

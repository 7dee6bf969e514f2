"""The stored index and its refresh, calls that run at the same time, evaluation on a grid, ids of any depth."""

from __future__ import annotations

import random
import threading
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.functions import ids, models
from corpusmill.operators import composites, indexing, metrics
from corpusmill.sources import tables

COUNTED = "corpusmill-calls"


def recorder(folder):
    """A backend that leaves a file for each text it was asked for."""

    def backend(texts):
        import uuid

        for t in texts:
            (folder / f"{COUNTED}-{uuid.uuid4().hex}").write_text(t)
        return models.hashed(texts)

    return backend


def asked(folder):
    found = sorted(p.read_text() for p in folder.glob(f"{COUNTED}-*"))
    for p in folder.glob(f"{COUNTED}-*"):
        p.unlink()
    return found


def seeds(spark, root):
    collections = spark.createDataFrame([("lib", "seed", ["en"], ["ISO 9001"], 40, 10)], "id string, path string, languages array<string>, standards array<string>, chunk_size int, chunk_overlap int")
    return indexing.seed_chunks(tables.seed_rows(tables.file_texts(tables.files(spark, str(root))), collections))


def test_a_folder_is_embedded_once(spark, tmp_path):
    root, calls = tmp_path / "root", tmp_path / "calls"
    (root / "seed").mkdir(parents=True)
    calls.mkdir()
    words = "quality management systems need context and planning to be of use to anybody at all, said the author"
    (root / "seed" / "a.txt").write_text(words)
    (root / "seed" / "b.txt").write_text("another text, which is short")
    store = indexing.ChunkStore(spark, str(tmp_path / "store"))
    run = lambda: store.publish(indexing.refreshed(store.read(), seeds(spark, root), recorder(calls), wait=0.0))
    assert store.read().count() == 0 and run() == 1
    first = {(r["source_path"], r["chunk_index"]): r for r in store.read().collect()}
    assert len(asked(calls)) == len(first) > 3
    assert run() == 2 and asked(calls) == []  # nothing changed: no call
    assert {(r["source_path"], r["chunk_index"]): r for r in store.read().collect()} == first
    (root / "seed" / "b.txt").unlink()
    (root / "seed" / "c.txt").write_text(words)  # said twice: no call
    (root / "seed" / "d.txt").write_text("something new")
    assert run() == 3 and asked(calls) == ["something new"] and store.versions() == [2, 3]
    names = {r["source_path"].rsplit("/", 1)[1] for r in store.read().collect()}
    assert names == {"a.txt", "c.txt", "d.txt"}


def test_sections_of_one_upload_replace_their_scope(spark, tmp_path):
    def of(rows):
        clauses = spark.createDataFrame(rows, "standard string, language string, clause_id string, title string, body string")
        return indexing.section_chunks(clauses, F.lit("u1"), F.lit("f.docx"))

    old = indexing.refreshed(spark.createDataFrame([], indexing.ROWS), of([("ISO 9001", "en", "4.1", "Context", "body"), ("ISO 9001", "en", "4.2", "Needs", ""), ("ISO 22301", "en", "1", "Scope", "x")]))
    assert {r["source_path"] for r in old.collect()} == {"uploads/u1/f.docx#4.1", "uploads/u1/f.docx#4.2", "uploads/u1/f.docx#1"}
    fresh = of([("ISO 9001", "en", "4.1", "Context", "new body")])
    kinds = {r["source_path"][-3:]: r["change"] for r in indexing.changes(old, fresh, ["collection_id"]).collect()}
    assert kinds == {"4.1": "changed", "4.2": "deleted"}
    new = indexing.refreshed(old, fresh, scope=["collection_id"]).collect()
    assert {(r["collection_id"], r["content"][:3]) for r in new} == {("iso-standards-ISO9001", "4.1"), ("iso-standards-ISO22301", "1 S")}


def test_failed_vectors_are_null_and_asked_again_by_wish(spark):
    fresh = spark.createDataFrame([("c", "p", 0, "text", "sha", {})], "collection_id string, source_path string, chunk_index long, content string, content_sha string, metadata map<string,string>")
    failing = lambda texts: [[0.0] * 64 for _ in texts]
    one = indexing.refreshed(spark.createDataFrame([], indexing.ROWS), fresh, failing)
    assert one.first()["embedding"] is None
    full = lambda texts: [[1.0] * 64 for _ in texts]
    assert indexing.refreshed(one, fresh, full).first()["embedding"] is None
    assert indexing.refreshed(one, fresh, full, again=True).first()["embedding"][0] == 1.0


def test_unfinished_snapshots_are_not_read(spark, tmp_path):
    store = indexing.ChunkStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("c", "p", 0, "t", "h", {}, None)], indexing.ROWS)
    store.publish(rows)
    (tmp_path / "s" / "v2").mkdir()
    assert store.versions() == [1] and store.read().count() == 1 and store.publish(rows) == 2


class Slow:
    def __init__(self, seconds=0.05, limit_first=False):
        self.lock, self.now, self.most, self.seconds, self.begun, self.limit_first = threading.Lock(), 0, 0, seconds, [], limit_first

    def __call__(self, texts):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            first = self.limit_first and not self.begun
            self.begun.append(time.monotonic())
        try:
            if first:
                raise models.RateLimited
            time.sleep(self.seconds)
            return [t.upper() for t in texts]
        finally:
            with self.lock:
                self.now -= 1


def test_calls_are_bounded_and_in_order():
    texts = [f"t{i}" for i in range(40)]
    for workers in (1, 3):
        slow, began = Slow(), time.monotonic()
        assert models.tried(slow, texts, None, batch=2, workers=workers) == [t.upper() for t in texts]
        assert slow.most == workers
    assert time.monotonic() - began < 0.05 * 20 * 0.8  # three at a time


def test_all_wait_where_one_is_limited():
    slow = Slow(0.01, limit_first=True)
    found = models.tried(slow, [f"t{i}" for i in range(12)], None, batch=1, workers=2, wait=0.2)
    assert found == [f"T{i}" for i in range(12)]
    first = min(slow.begun)
    assert sum(1 for b in slow.begun if b - first < 0.45) <= 3  # the limited call and what was under way


def test_failures_stay_in_place():
    def odd(texts):
        if "t3" in texts:
            raise models.ModelError
        return texts

    assert models.tried(odd, [f"t{i}" for i in range(6)], "-", batch=2, workers=4, wait=0.0) == ["t0", "t1", "-", "-", "t4", "t5"]


def test_translation_with_several_calls(spark):
    rows = spark.createDataFrame([(i, f"{i}.1", "title", "\n\n".join(f"paragraph {j} of {i} " + "word " * 60 for j in range(30))) for i in range(1, 4)], "k int, clause_id string, title string, body string")

    def up(texts):
        return [t.upper() for t in texts]

    each = [sorted(map(tuple, composites.translated(rows, ["k"], up, "en", "fr", most=400, workers=w).collect())) for w in (1, 3)]
    assert each[0] == each[1] and all(r[4] is None and r[3].isupper() for r in each[0])


def test_grid_with_gaps_and_stale_series(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rng = random.Random(4)
    rows = [(s, at(m), e, float(e)) for e, (s, m) in enumerate((rng.choice("aab"), rng.choice([rng.uniform(-30, 200), rng.randint(-3, 20) * 10])) for _ in range(60))] + [("c", at(50), 99, 1.0), ("d", at(-400), 100, 1.0)]
    samples = spark.createDataFrame(rows, "s string, ts timestamp, event_id long, value double")
    for step, back in ((10, 25), (10, 10), (30, 7)):
        found = {(r["at"], r["s"]): r["value"] for r in metrics.stepped(samples, ["s"], F.lit(at(0)), F.lit(at(120)), f"{step} minutes", f"{back} minutes").collect()}
        want = {}
        for m in range(0, 121, step):
            for s in "abcd":
                near = [(t, e, v) for x, t, e, v in rows if x == s and at(m - back) < t <= at(m)]
                if near:
                    want[at(m), s] = max(near)[2]
        assert found == want


def test_ids_of_any_depth_sort_as_numbers(spark):
    rng = random.Random(5)
    made = {".".join(str(rng.choice([0, 1, 2, 9, 10, 11, 99, 100, 10**rng.randint(3, 60)])) for _ in range(rng.randint(1, 9))) for _ in range(400)}
    rows = spark.createDataFrame([(m,) for m in made], "c string").select("c", ids.sortable(F.col("c")).alias("k")).collect()
    assert [r["c"] for r in sorted(rows, key=lambda r: r["k"])] == sorted(made, key=lambda c: [int(p) for p in c.split(".")])

"""Streams that are killed and started again: state with a time to live, scrapes, the job status table, replacement."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import metrics
from corpusmill.sources import sinks
from corpusmill.streaming import jobs, scrape

EVENT = "job_id long, ts timestamp, status string"
START = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put(spark, folder, name, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{name}")


def ran(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(90)


@pytest.fixture
def rocks(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}  # else a query with a time to live has always another batch
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


def test_jobs_outlive_a_restart_and_not_their_time(spark, tmp_path, rocks):
    given_, told, mark = (str(tmp_path / x) for x in ("in", "told", "mark"))
    at = lambda s: START + timedelta(seconds=s)

    def run(ttl):
        stream = spark.readStream.schema(EVENT).parquet(f"{given_}/*")
        ran(jobs.ttl_jobs(stream, ttl).writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{told}/batch={i}")).outputMode("update").option("checkpointLocation", mark))
        return sorted((r["batch"], r["job_id"], r["status"], r["fresh"]) for r in spark.read.parquet(told).collect())

    put(spark, given_, "a", [(1, at(5), "running"), (1, at(1), "queued"), (2, at(3), "queued"), (3, None, "odd")], EVENT)
    assert run(3600) == [(0, 1, "running", True), (0, 2, "queued", True)]
    # from the checkpoint: late and repeated rows say nothing, new ones do, and are not fresh
    put(spark, given_, "b", [(1, at(2), "queued"), (2, at(3), "queued"), (2, at(9), "completed"), (2, at(9), "completed")], EVENT)
    assert run(3600)[2:] == [(1, 2, "completed", False)]
    assert sorted((r["job_id"], r["status"]) for r in jobs.live_jobs(spark, mark).collect()) == [(1, "running"), (2, "completed")]
    # a short time to live: what was left alone is forgotten
    mark = str(tmp_path / "short")
    told = str(tmp_path / "told_short")
    run(1)
    time.sleep(2)
    assert jobs.live_jobs(spark, mark).count() == 0
    put(spark, given_, "c", [(1, at(2), "queued")], EVENT)
    assert run(1)[-1][1:] == (1, "queued", True)


def test_status_table(spark, tmp_path):
    kind = "job_id long, ts timestamp, status string, progress int, error string"
    given_, folder, mark = (str(tmp_path / x) for x in ("in", "status", "mark"))
    now = datetime.now()
    ago = lambda s: now - timedelta(seconds=s)
    put(spark, given_, "a", [(1, ago(50), "queued", 0, None), (1, ago(40), "running", 10, None), (2, ago(40), "queued", 0, None), (9, ago(9000), "completed", 100, None)], kind)
    stream = lambda: spark.readStream.schema(kind).parquet(f"{given_}/*")
    ran(jobs.status_sink(stream(), folder, mark))
    before = sorted(map(tuple, jobs.job_status(spark, folder).collect()))
    assert [(r[0], r[2], r[3]) for r in before] == [(1, "running", 10), (2, "queued", 0)]
    ran(jobs.status_sink(stream(), folder, str(tmp_path / "again")))  # the same batch id, as after a kill before the commit
    assert sorted(map(tuple, jobs.job_status(spark, folder).collect())) == before
    assert jobs.polled(spark, folder, 1, most=0)["status"] == "running" and jobs.polled(spark, folder, 9, most=0) is None
    put(spark, given_, "b", [(1, ago(10), "completed", 100, None), (2, ago(45), "late", 0, None)], kind)
    ran(jobs.status_sink(stream(), folder, mark))
    assert jobs.polled(spark, folder, 1, most=60)["progress"] == 100 and jobs.polled(spark, folder, 2, most=0)["status"] == "queued"
    assert jobs.vacuumed(spark, folder) == [] and jobs.vacuumed(spark, folder, F.lit(now + timedelta(seconds=7180))) == [0]
    assert sorted((r["job_id"], r["status"]) for r in jobs.job_status(spark, folder).collect()) == [(1, "completed"), (2, "late")]


def test_replacement_on_arrival(spark, tmp_path):
    given_, folder, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    kind = "scope string, n long"
    for name, rows in (("a", [("x", 1), ("x", 2), ("y", 3)]), ("b", [("x", 9)])):
        put(spark, given_, name, rows, kind)
        ran(jobs.replace_on_arrival(spark.readStream.schema(kind).parquet(f"{given_}/*"), folder, ["scope"], mark))
    assert sorted((r["scope"], r["n"]) for r in spark.read.parquet(folder).collect()) == [("x", 9), ("y", 3)]


@given(st.dictionaries(st.from_regex(r"[a-z_]\w{0,5}", fullmatch=True).filter(str.isascii), st.text(max_size=12), max_size=3), st.floats(allow_nan=False))
def test_lines_are_read_as_they_were_written(labels, value):
    told = ",".join('{}="{}"'.format(k, v.replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')) for k, v in labels.items())
    assert scrape.parsed(f"calls_total{{{told}}} {value!r}".split("\n")[0]) == ("calls_total", labels, value)


def test_lines():
    assert scrape.parsed("up 1") == ("up", {}, 1.0) and scrape.parsed('a{b="}",} +Inf 1700000000') == ("a", {"b": "}"}, float("inf"))
    for odd in ("", "# HELP up it is", "a{b=c} 1", "a{b=\"c\"", "a one", "9a 1"):
        assert scrape.parsed(odd) is None


def test_exposition_comes_back(spark):
    df = spark.createDataFrame([("calls", 'a"b\\', "x\ny", 2.5)], "metric string, model string, note string, value double")
    assert scrape.parsed(sinks.exposition(df, ["model", "note"]).first()["line"]) == ("calls", {"model": 'a"b\\', "note": "x\ny"}, 2.5)


def test_scrapes(spark, tmp_path):
    target, spool, out, mark = (str(tmp_path / x) for x in ("metrics.txt", "spool", "out", "mark"))

    def run(values, path=out, until=None):
        """A query that scrapes once for each value; ended like a kill when all were read."""
        query, seen = None, 0
        for v in values:
            with open(target, "w") as f:
                f.write(f'# TYPE c counter\nc{{m="a"}} {v}\nc{{m="b\\"q"}} 1\n')
            stream = scrape.scraped(spark, [f"file://{target}", "file:///nowhere/at/all"], spool)
            query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).trigger(once=True).start()
            assert query.awaitTermination(120)
            seen += 1
        return query

    run([1, 5, 2, 4])  # the counter restarts after 5
    rows = spark.read.parquet(out).filter("labels['m'] = 'a'").orderBy("scraped_at").collect()
    assert [r["value"] for r in rows] == [1, 5, 2, 4]
    assert {r["labels"]["m"] for r in spark.read.parquet(out).collect()} == {"a", 'b"q'}
    samples = spark.read.parquet(out).select(F.col("labels")["m"].alias("m"), F.col("scraped_at").alias("ts"), F.monotonically_increasing_id().alias("event_id"), "value")
    assert {r["m"]: r["increase"] for r in metrics.increase(samples, ["m"]).collect()}["a"] == 8


def test_a_scrape_is_read_again_after_a_kill(tmp_path):
    target = tmp_path / "m.txt"
    reader = scrape.ScrapeReader([f"file://{target}"], str(tmp_path / "spool"), 1)
    start = reader.initialOffset()
    target.write_text("c 1")
    first = reader.latestOffset()
    said = [list(reader.read(p)) for p in reader.partitions(start, first)]
    target.write_text("c 2")
    again = scrape.ScrapeReader([f"file://{target}"], str(tmp_path / "spool"), 1)  # another process
    assert [list(again.read(p)) for p in again.partitions(start, first)] == said and said[0][0][2:] == ("c", {}, 1.0)
    second = again.latestOffset()
    again.commit(first)
    assert second["scrape"] == first["scrape"] + 1
    again.commit(second)
    assert [x[0][4] for x in [list(again.read(p)) for p in again.partitions(first, second)]] == [2.0]
    assert again.latestOffset()["scrape"] == second["scrape"] + 1

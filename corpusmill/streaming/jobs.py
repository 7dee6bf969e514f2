"""Structured Streaming forms of the metric and job-state operators."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import removed

JOB = "job_id long, status string, at long, fresh boolean"
TTL_SECONDS = 7200


def event_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def counter_windows(events: DataFrame, late: str | None = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, event_type, n, total in tumbling windows; later than `late` is dropped (None: the stream has its watermark)."""
    rows = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class JobState(StatefulProcessor):
    """The last status of a job, forgotten when it was left alone for the time to live.

    Told are changes alone: what is older than the state, or says again what it says, changes nothing.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        before = self.state.get() if self.state.exists() else None
        last = max(((r["at"], r["status"]) for r in rows if r["at"] is not None), default=None)
        if last is None or before is not None and (last[0] < before[1] or last == (before[1], before[0])):
            return
        self.state.update((last[1], last[0]))
        yield Row(job_id=key[0], status=last[1], at=last[0], fresh=before is None)

    def close(self) -> None:
        pass


def ttl_jobs(events: DataFrame, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """job_id, status, updated_at and whether the job was unknown or forgotten, whenever a job's status changes.

    events: job_id, ts (timestamp), status. State is one row a job, with a time to live of its own in the state store
    (counted from the last update); needs the RocksDB provider.
    """
    rows = events.select("job_id", F.unix_micros("ts").alias("at"), "status").groupBy("job_id")
    told = rows.transformWithState(statefulProcessor=JobState(int(ttl_seconds * 1000)), outputStructType=JOB, outputMode="Update", timeMode="ProcessingTime")
    return told.select("job_id", "status", F.timestamp_micros("at").alias("updated_at"), "fresh")


def live_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The jobs that a query of `ttl_jobs` knows now, read from its state in the checkpoint: job_id, status, updated_at."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "job").load()
    value = F.col("value.value") if "value" in rows.schema["value"].dataType.names else F.col("value")
    ends = F.col("value.ttlExpirationMs") if "ttlExpirationMs" in rows.schema["value"].dataType.names else F.col("expiration_timestamp")
    alive = ends.isNull() | (ends > F.unix_millis(F.current_timestamp()))
    return rows.filter(alive).select(F.col("key.job_id").alias("job_id"), value["status"].alias("status"), F.timestamp_micros(value["at"]).alias("updated_at"))


def status_sink(updates: DataFrame, folder: str, checkpoint: str):
    """Keeps a status table: the last row (ts, status, progress, error) of each job of a batch, in a folder of the batch's id.

    A batch that comes again overwrites its own folder, so it changes nothing.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("job_id").agg(F.max(F.struct("ts", "status", "progress", "error")).alias("s")).select("job_id", "s.*")
        last.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return updates.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


STATUS = "job_id long, ts timestamp, status string, progress int, error string"


def job_status(spark: SparkSession, folder: str, now: Column | None = None, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """job_id, ts, status, progress, error of each job: its last row in any batch, unless that is older than the time to live."""
    rows = spark.read.schema(STATUS).parquet(folder)
    last = rows.groupBy("job_id").agg(F.max(F.struct("ts", "batch", "status", "progress", "error")).alias("s")).select("job_id", "s.ts", "s.status", "s.progress", "s.error")
    return last.filter(F.col("ts") > (F.current_timestamp() if now is None else now) - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def polled(spark: SparkSession, folder: str, job_id: int, done: tuple[str, ...] = ("completed", "failed"), every: float = 1.0, most: float = 60.0, **options) -> Row | None:
    """The status of a job when it is one of `done`, or what is known of it after `most` seconds."""
    ends = time.monotonic() + most
    while True:
        row = job_status(spark, folder, **options).filter(F.col("job_id") == job_id).first()
        if row is not None and row["status"] in done or time.monotonic() >= ends:
            return row
        time.sleep(every)


def vacuumed(spark: SparkSession, folder: str, now: Column | None = None, ttl_seconds: float = TTL_SECONDS) -> list[int]:
    """Removes the batches whose rows have all expired, so the table is as large as the time to live; their ids."""
    least = (F.current_timestamp() if now is None else now) - F.make_dt_interval(secs=F.lit(ttl_seconds))
    rows = spark.read.schema(STATUS).parquet(folder).groupBy("batch").agg(F.max("ts").alias("newest")).filter(F.col("newest") <= least)
    old = sorted(r["batch"] for r in rows.collect())  # a row a batch
    for batch in old:
        removed(spark, f"{folder}/batch={batch}")
    return old


def replace_on_arrival(stream: DataFrame, folder: str, scope: list[str], checkpoint: str):
    """Each batch replaces the partitions of the scopes that it brings."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(folder)

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)

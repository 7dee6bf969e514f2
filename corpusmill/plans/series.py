"""Queries over events: counters, gauges, histograms and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.tables import table
from ..streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COUNTER = """c AS (SELECT event_id, ts, event_type, user_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type, user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS value FROM events),
d AS (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before FROM c),
i AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS step FROM d)"""


def counters(spark, folder) -> DataFrame:
    """A counter for each type and user that restarts every day."""
    own = Window.partitionBy("event_type", "user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, folder, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", F.sum("cents").over(own).alias("value"))


@query(f"WITH {COUNTER} SELECT event_type, user_id, sum(step)::BIGINT AS increase FROM i GROUP BY event_type, user_id")
def counter_increase(spark, folder):
    return metrics.increase(counters(spark, folder), ["event_type", "user_id"])


@query(f"""WITH {COUNTER}, h AS (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS b FROM c)
SELECT event_type, date_trunc('hour', ts) AS start, round(sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END) / 3600.0, 6)::DOUBLE AS rate FROM h GROUP BY ALL""")
def counter_rate_hourly(spark, folder):
    rows = metrics.rate(counters(spark, folder), ["event_type", "user_id"], "1 hour")
    return rows.groupBy("event_type", F.col("start").cast("timestamp_ntz").alias("start")).agg(F.round(F.sum("increase") / 3600.0, 6).cast("double").alias("rate"))


@query(f"WITH {COUNTER}, u AS (SELECT user_id, sum(step) AS s FROM i GROUP BY user_id) SELECT count(*) FILTER (WHERE s > 0)::BIGINT AS n_active FROM u")
def active_users(spark, folder):
    found = metrics.increase(counters(spark, folder), ["event_type", "user_id"]).filter("increase > 0")
    return found.agg(F.count_distinct("user_id").alias("n_active"))


@query(f"WITH {COUNTER} SELECT user_id, sum(step)::BIGINT AS total FROM i GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10")
def topk_users(spark, folder):
    found = metrics.increase(counters(spark, folder), ["event_type", "user_id"])
    return found.groupBy("user_id").agg(F.sum("increase").alias("total")).orderBy(F.desc("total"), "user_id").limit(10)


@query("""SELECT user_id, round(least(1.0, count(*) FILTER (WHERE event_type = 'error') / greatest(1.0, count(*)::DOUBLE)), 6)::DOUBLE AS ratio FROM events GROUP BY user_id""")
def ratio_clamped(spark, folder):
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count(F.lit(1)).alias("b"))
    return rows.select("user_id", F.round(metrics.clamped_ratio(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("ratio"))


@query("SELECT event_type, max(v) AS highest FROM (SELECT event_type, user_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def gauge_max_last(spark, folder):
    return metrics.latest(table(spark, folder, "events"), ["event_type", "user_id"]).groupBy("event_type").agg(F.max("value").alias("highest"))


def _two(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("value"))
    pick = lambda kind: rows.filter(F.col("event_type") == kind).select("user_id", "value")
    return pick("error"), pick("click")


TWO = "a AS (SELECT user_id, count(*)::BIGINT AS value FROM events WHERE event_type = 'error' GROUP BY ALL), b AS (SELECT user_id, count(*)::BIGINT AS value FROM events WHERE event_type = 'click' GROUP BY ALL)"


@query(f"WITH {TWO} SELECT user_id, (coalesce(a.value, 0) + coalesce(b.value, 0))::BIGINT AS value FROM a FULL JOIN b USING (user_id)")
def outer_add_label_sets(spark, folder):
    return metrics.outer_add(*_two(spark, folder), ["user_id"])


@query(f"WITH {TWO} SELECT * FROM a UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def left_biased_or(spark, folder):
    return metrics.left_or(*_two(spark, folder), ["user_id"])


@query("SELECT DISTINCT event_type FROM events WHERE regexp_full_match(event_type, 'c.*|view')")
def label_values(spark, folder):
    return table(spark, folder, "events").filter(metrics.matches(F.col("event_type"), "c.*|view")).select("event_type").distinct()


@query("""SELECT event_type, le, count(*) FILTER (WHERE le = '+Inf' OR value <= try_cast(le AS DOUBLE))::BIGINT AS n
FROM events, (SELECT unnest(['1.0', '5.0', '10.0', '25.0', '50.0', '100.0', '+Inf']) AS le) GROUP BY event_type, le""")
def latency_histogram(spark, folder):
    return metrics.histogram(table(spark, folder, "events"), ["event_type"])


@query("SELECT event_type, count(*)::BIGINT AS requests, count(*) FILTER (WHERE value > 50)::BIGINT AS slow, sum((props->>'k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY event_type")
def usage_by_model(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") > 50).alias("slow"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


@query("SELECT coalesce(sum(user_id), 0)::BIGINT AS total FROM events WHERE event_type = 'no such type'")
def empty_default_row(spark, folder):
    return metrics.or_zero(table(spark, folder, "events").filter("event_type = 'no such type'"), F.col("user_id"), "total")


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 7200 SECOND")
def ttl_filter(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts")
    last, now = events.groupBy("user_id").agg(F.max("ts").alias("last_seen")), events.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).filter(F.expr(f"now - last_seen > interval {jobs.TTL_SECONDS} seconds")).drop("now")

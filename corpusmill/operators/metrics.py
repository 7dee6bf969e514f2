"""Counters, gauges and histograms as rows of labels, time and value.

An increase is the sum of a counter's steps, where a fall is a restart from
zero. It is taken within spans of time first and across them from each span's
first and last value, so a busy series is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "6 hours"
#: Upper bounds of latency buckets.
BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)


def _step(value: str, before: Column) -> Column:
    return F.when(before.isNull(), F.col(value) - F.col(value)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)


def increase(samples: DataFrame, labels: list[str], ts: str = "ts", order: str = "event_id", value: str = "value", span: str = SPAN) -> DataFrame:
    """labels and increase of each series over all its samples."""
    rows = samples.withColumn("_span", F.window(ts, span)["start"])
    own = Window.partitionBy(*labels, "_span").orderBy(ts, order)
    rows = rows.withColumn("_inc", _step(value, F.lag(value).over(own)))
    at = F.struct(ts, order)
    spans = rows.groupBy(*labels, "_span").agg(F.sum("_inc").alias("_inc"), F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*labels).orderBy("_span"))
    spans = spans.withColumn("_edge", _step("_first", before))
    return spans.groupBy(*labels).agg(F.sum(F.col("_inc") + F.col("_edge")).alias("increase"))


def rate(samples: DataFrame, labels: list[str], interval: str, ts: str = "ts", order: str = "event_id", value: str = "value") -> DataFrame:
    """start, labels and the increase a second within each interval."""
    rows = samples.withColumn("start", F.window(ts, interval)["start"])
    seconds = F.lit(interval).cast(f"interval day to second")
    length = F.extract(F.lit("DAY"), seconds) * 86400 + F.extract(F.lit("HOUR"), seconds) * 3600 + F.extract(F.lit("MINUTE"), seconds) * 60
    found = increase(rows, [*labels, "start"], ts, order, value, interval)
    return found.withColumn("rate", F.col("increase") / length)


def latest(samples: DataFrame, labels: list[str], ts: str = "ts", order: str = "event_id", value: str = "value") -> DataFrame:
    """labels and the last value of each series: an aggregate, combined before it is shuffled."""
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(ts, order)).alias(value))


def left_or(left: DataFrame, right: DataFrame, labels: list[str]) -> DataFrame:
    """All of left, and what right has for other labels."""
    return left.unionByName(right.join(left.select(*labels), labels, "left_anti"))


def outer_add(left: DataFrame, right: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    """Sums by label set; a missing side counts zero."""
    return left.unionByName(right).groupBy(*labels).agg(F.sum(value).alias(value))


def or_zero(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row even of no rows."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def labelled(samples: DataFrame, label: str, value: str) -> DataFrame:
    """All series under one value of a label."""
    return samples.withColumn(label, F.lit(value))


def instant(samples: DataFrame, labels: list[str], at: Column, lookback: str = "5 minutes", ts: str = "ts", order: str = "event_id", value: str = "value") -> DataFrame:
    """labels and the last value of each series in the lookback before a moment; no time."""
    near = (F.col(ts) <= at) & (F.col(ts) > at - F.expr(f"INTERVAL {lookback}"))
    return latest(samples.filter(near), labels, ts, order, value)


def ranged(samples: DataFrame, labels: list[str], step: str, ts: str = "ts", order: str = "event_id", value: str = "value") -> DataFrame:
    """start, labels and the last value of each series in each step."""
    return latest(samples.withColumn("start", F.window(ts, step)["start"]), [*labels, "start"], ts, order, value)


def stepped(samples: DataFrame, labels: list[str], start: Column, end: Column, step: str, lookback: str = "5 minutes", ts: str = "ts", order: str = "event_id", value: str = "value") -> DataFrame:
    """at, labels, value: each series on the grid start, start + step, ... up to end; at a step counts the last sample of the lookback before it.

    A sample holds from the first step at or after it until the step before the next sample's, as long as it is fresh. Of the samples between
    two steps only the last can count, so series are reduced to a sample a step before they are put in order; no grid is joined.
    """
    micros = lambda i: F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {i})")
    begin, wide, fresh = F.unix_micros(start), micros(step), micros(lookback)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.unix_micros(ts) - begin) / wide).cast("long"))
    last = F.floor((F.unix_micros(end) - begin) / wide).cast("long")
    rows = samples.filter((F.col(ts) <= end) & (F.unix_micros(ts) > begin - fresh)).withColumn("_step", first).withColumn("_end", last)
    rows = rows.groupBy(*labels, "_step", "_end").agg(F.max_by(F.struct(F.col(ts).alias("t"), F.col(value).alias("v")), F.struct(ts, order)).alias("_s"))
    after = F.lead("_step").over(Window.partitionBy(*labels).orderBy("_step"))
    held = F.ceil((F.unix_micros("_s.t") + fresh - begin) / wide).cast("long") - 1
    until = F.least(held, F.coalesce(after - 1, F.col("_end")), F.col("_end"))
    rows = rows.withColumn("_until", until).filter("_until >= _step")
    rows = rows.withColumn("_at", F.explode(F.sequence("_step", "_until")))
    return rows.select(F.timestamp_micros(begin + F.col("_at") * wide).alias("at"), *labels, F.col("_s.v").alias(value))


def lifetime(samples: DataFrame, labels: list[str], by: list[str], value: str = "value", **at: str) -> DataFrame:
    """by and the sum of its counters as they stand last."""
    return latest(samples, labels, value=value, **at).groupBy(*by).agg(F.sum(value).alias(value))


def ratio_on(top: DataFrame, bottom: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    """labels and the clamped ratio of series that both sides have."""
    both = top.join(bottom.withColumnRenamed(value, "_b"), labels)
    return both.select(*labels, clamped_ratio(F.col(value).cast("double"), F.col("_b").cast("double")).alias("ratio"))


def clamped_ratio(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), a / F.greatest(F.lit(1.0), b))


def histogram(samples: DataFrame, labels: list[str], value: str = "value", bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """labels, le, n: cumulative buckets, one pass over the samples."""
    counts = samples.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(value).alias("_all"))
    cells = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return counts.select(*labels, F.explode(cells).alias("c")).select(*labels, "c.le", "c.n")


def histogram_totals(samples: DataFrame, labels: list[str], value: str = "value") -> DataFrame:
    """labels, sum and count of a histogram."""
    return samples.groupBy(*labels).agg(F.sum(value).alias("sum"), F.count(value).alias("count"))


def matches(label: Column, pattern: str) -> Column:
    """A matcher holds for the whole label."""
    return label.rlike(f"^(?:{pattern})$")

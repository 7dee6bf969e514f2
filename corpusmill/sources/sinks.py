"""Metric exposition and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped_label


def exposition(samples: DataFrame, labels: list[str]) -> DataFrame:
    """line: `metric{label="value"} number` of rows metric, labels..., value."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped_label(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels])
    return samples.select(F.concat(F.col("metric"), F.lit("{"), pairs, F.lit("} "), F.col("value").cast("string")).alias("line"))


def report(findings: DataFrame, mappings: DataFrame, coverage: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a compliance report, each a table: summary, findings, mappings, coverage.

    summary has one row: counts of findings, distinct mapped clauses, clauses and covered ones.
    """
    own = findings.agg(F.count(F.lit(1)).alias("n_findings"))
    mapped = mappings.agg(F.count(F.lit(1)).alias("n_mappings"), F.count_distinct("clause_id").alias("n_clauses_mapped"))
    covered = coverage.agg(F.count(F.lit(1)).alias("n_clauses"), F.count_if(F.col("status") == "covered").alias("n_covered"))
    told = mappings.join(findings.select("finding_id", "finding_text"), "finding_id", "left")
    told = told.select("finding_id", F.substring("finding_text", 1, 120).alias("finding"), "clause_id", "clause_title", F.concat(F.col("relevance_pct").cast("string"), F.lit("%")).alias("relevance"))
    return {"summary": own.crossJoin(mapped).crossJoin(covered), "findings": findings, "mappings": told, "coverage": coverage}


def save_report(sheets: dict[str, DataFrame], folder: str) -> None:
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def exportable(projects: DataFrame) -> DataFrame:
    """Only what was approved may be exported."""
    return projects.filter(F.col("status") == "approved")


def dated(sheets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The summary with the day of the report."""
    return sheets | {"summary": sheets["summary"].withColumn("report_date", F.date_format(F.current_date(), "yyyy-MM-dd"))}


def completed(rows: DataFrame, folder: str) -> None:
    """A marker file with the number of rows, written when they are."""
    rows.agg(F.format_string("rows=%d", F.count(F.lit(1))).alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def save_originals(files: DataFrame, folder: str) -> None:
    """Bytes with their size, partitioned by kind."""
    files.withColumn("size_bytes", F.length("content").cast("long")).write.mode("append").partitionBy("kind").parquet(folder)

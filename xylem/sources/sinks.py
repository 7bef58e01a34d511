"""Sinks for matches, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    df.write.format(fmt).mode(mode).options(**options).save(path)


def metrics_table(metrics: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Long rows (metric, run, value) as one row per metric and a column per run; NA where there is none."""
    wide = metrics.groupBy("metric").pivot("run", runs).agg(F.first("value"))
    return wide.select("metric", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in wide.columns if c != "metric"])


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)

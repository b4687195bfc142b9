"""Checks and timing summaries over feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_gate(df: DataFrame, batch: str, suspicious: Column) -> DataFrame:
    """Per batch: rows, suspicious rows, and whether there is any."""
    return df.groupBy(batch).agg(F.count("*").alias("n_rows"), F.sum(F.when(suspicious, 1).otherwise(0)).alias("n_suspicious"), F.bool_or(F.coalesce(suspicious, F.lit(False))).alias("suspicious"))


def arrival_gaps(df: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Per key, nearest-rank percentiles of the microseconds between arrivals: p50, p95, p99, longest."""
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(Window.partitionBy(key).orderBy(time, order)).cast("timestamp"))
    g = df.select(key, gap.alias("g")).filter("g is not null").groupBy(key)
    cols = [F.expr(f"cast(percentile_disc({q}) within group (order by g) as bigint)").alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return g.agg(*cols, F.max("g").alias("longest"))


def run_spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, the smallest, median and largest value."""
    return df.groupBy(key).agg(F.min(value).alias("low"), F.median(value).alias("mid"), F.max(value).alias("high"))

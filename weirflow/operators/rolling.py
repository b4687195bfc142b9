"""Count-based rolling reports over a feed of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_report(feed: DataFrame, batch: str, key: str, value: str, every: int, window: int) -> DataFrame:
    """Every ``every`` batches, count, mean and maximum of each key over the last ``window`` batches.

    Rows are first summed per (batch, key), map-side; each partial row is then copied to the
    ``ceil(window / every)`` reports it belongs to, so no join is needed and what is shuffled is
    a row per batch and key at most.  Mean is the quotient of sum and count.
    """
    part = feed.groupBy(F.col(batch).alias("_b"), F.col(key).alias(key)).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_m"), F.sum(value).alias("_s"), F.max(value).alias("_x")
    )
    last = part.select("_b").distinct().filter(F.pmod("_b", F.lit(every)) == every - 1).withColumnRenamed("_b", "report")
    first = (F.expr(f"_b div {every}") * every + (every - 1)).cast("bigint")
    each = part.withColumn("report", F.explode(F.sequence(first, F.col("_b") + window - 1, F.lit(every).cast("bigint")))).filter("report >= _b and report < _b + %d" % window)
    return (
        each.join(last, "report", "left_semi")
        .groupBy("report", key)
        .agg(F.sum("_n").alias("ticks"), (F.sum("_s").cast("double") / F.sum("_m")).alias(f"avg_{value}"), F.max("_x").cast("double").alias(f"max_{value}"))
    )

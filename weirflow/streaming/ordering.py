"""Stateful streaming operators: restoring sequence, and rolling reports over batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def reorder(stream: DataFrame, group: str, seq: str, value: str, value_type: str = "double") -> DataFrame:
    """Rows of each group in sequence (0, 1, ...): early ones wait in state until all before them came.

    What waits is bounded by how far a source runs ahead, not by the stream's length.
    """

    def restore(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, seqs, values = state.get if state.exists else (0, [], [])
        waiting = dict(zip(seqs, values, strict=True))
        for f in frames:
            for s, v in zip(f[seq], f[value], strict=True):
                if s >= following:
                    waiting[int(s)] = v
        out = []
        while following in waiting:
            out.append((key[0], following, waiting.pop(following)))
            following += 1
        state.update((following, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=[group, seq, value])

    kind = dict(stream.dtypes)[group]
    return stream.select(group, seq, value).groupBy(group).applyInPandasWithState(
        restore, f"{group} {kind}, {seq} bigint, {value} {value_type}", f"following bigint, seqs array<bigint>, held array<{value_type}>", "append", GroupStateTimeout.NoTimeout
    )


def rolling_stream(stream: DataFrame, batch: str, key: str, value: str, every: int, window: int) -> DataFrame:
    """Count, mean and maximum per key for each report, kept up to date: a batch adds to the reports it belongs to.

    The same reports as over a finished table, by a stateful aggregation with one row per report and key;
    use it in update or complete mode.
    """
    first = (F.expr(f"{batch} div {every}") * every + (every - 1)).cast("bigint")
    each = stream.withColumn("report", F.explode(F.sequence(first, F.col(batch).cast("bigint") + window - 1, F.lit(every).cast("bigint"))))
    return each.groupBy("report", key).agg(F.count("*").alias("ticks"), (F.sum(value).cast("double") / F.count(value)).alias(f"avg_{value}"), F.max(value).cast("double").alias(f"max_{value}"))

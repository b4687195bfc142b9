"""Round-robin fan-out, sequence tags, merges and their verification.

A batch carries ``seq`` (from 0).  Fan-out deals batch i to stream ``i mod n``; merges take the
streams' tables back together, in any order or in sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ProtocolError

MOST_STREAMS = 256


def round_robin(df: DataFrame, streams: int, seq: str = "seq", name: str = "stream_id") -> DataFrame:
    """Adds each row's stream; rows keep their partitions until they are sent."""
    if not 1 <= streams <= MOST_STREAMS:
        raise ProtocolError(f"{streams} streams, there may be 1 to {MOST_STREAMS}")
    return df.withColumn(name, F.pmod(F.col(seq), F.lit(streams)).cast("int"))


def fan_out(df: DataFrame, streams: int, seq: str = "seq", rows: Sequence[str] = ()) -> DataFrame:
    """One partition per stream, in sequence inside each."""
    return round_robin(df, streams, seq).repartitionByRange(streams, "stream_id").sortWithinPartitions("stream_id", seq, *rows)


def merge(parts: Sequence[DataFrame], keys: bool = False, seq: str = "seq") -> DataFrame:
    """All streams' rows in any order; the sequence tag is kept if ``keys``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if keys else out.drop(seq)


def merge_ordered(parts: Sequence[DataFrame], seq: str = "seq", rows: Sequence[str] = (), until_gap: bool = True) -> DataFrame:
    """All streams' rows in sequence, a total order by range partitions.

    With ``until_gap`` the result ends where the next batch in turn is missing, as a merge that pulls the
    streams in rotation does; batches behind it are left out.
    """
    all_rows = merge(parts, keys=True)
    if until_gap:
        seen = all_rows.select(seq).distinct()
        gap = seen.select((F.col(seq) + 1).alias(seq)).union(all_rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias(seq))).join(seen, seq, "left_anti").agg(F.min(seq))
        all_rows = all_rows.filter(F.col(seq) < F.lit(gap.first()[0]))
    return all_rows.orderBy(seq, *rows)


def announced(indexes: Sequence[int], streams: int) -> None:
    """Each connection announces a different index below the number of streams."""
    seen = set()
    for i in indexes:
        if not 0 <= i < streams:
            raise ProtocolError(f"stream index {i} is out of range, there are {streams}")
        if i in seen:
            raise ProtocolError(f"stream index {i} is announced twice")
        seen.add(i)


def stream_order(df: DataFrame, streams: int, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Per stream: batches, first and last sequence number, and whether all are in its residue class with none missing."""
    b = df.select(stream, seq).distinct()
    g = b.groupBy(stream).agg(F.count("*").alias("batches"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.bool_and(F.pmod(F.col(seq), F.lit(streams)) == F.col(stream)).alias("_own"))
    return g.select(stream, "batches", "first_seq", "last_seq", (F.col("_own") & (F.col("last_seq") - F.col("first_seq") == (F.col("batches") - 1) * streams)).alias("complete"))


def sequence_gaps(df: DataFrame, stream: str = "stream_id", seq: str = "seq", step: int = 1) -> DataFrame:
    """Rows before which a sequence number is missing in their stream: stream, seq, expected."""
    before = F.lag(seq).over(Window.partitionBy(stream).orderBy(seq))
    return df.select(stream, seq).distinct().withColumn("expected", before + step).filter("expected is not null and expected <> %s" % seq)


def reads_in_order(df: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """Per batch, whether its first value is its sequence number: seq, first_value, in_order."""
    return df.groupBy(seq).agg(F.min(value).alias("first_value")).withColumn("in_order", F.col("first_value") == F.col(seq))

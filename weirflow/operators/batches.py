"""Batch identity, row windows, concatenation and dictionary codes.

Spark keeps no order of its own; tables that have one carry ``batch_id`` and ``row_id`` columns, and
every operator here takes its order from columns it is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormatError
from ..shared import checkpointed
from ..sources.arrow_ipc import check_window


def with_batch_ids(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Adds batch_id and row_id from a dense integer column (0, 1, ...): no shuffle."""
    at = F.col(order).cast("bigint")
    row = F.pmod(at, F.lit(rows))
    return df.withColumn("batch_id", F.expr(f"cast((cast({order} as bigint) - pmod(cast({order} as bigint), {rows})) div {rows} as bigint)")).withColumn("row_id", row.cast("bigint"))


def numbered(df: DataFrame, part: str, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """A running number from 0 over all rows in the order of (part, *order).

    Rows are dealt to tasks by ranges of (part, *order), so a large part takes many of them; the ranges'
    sizes, one row a task, are summed and joined back.  Rows that agree in all of these columns share a task.
    """
    dealt = checkpointed(df.repartitionByRange(part, *order).sortWithinPartitions(part, *order))
    at = F.monotonically_increasing_id()  # the task in the upper bits, its row below
    placed = dealt.withColumn("_task", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = sizes.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_task").select(*dealt.columns, (F.col("_before") + F.col("_row")).alias(name))  # as many rows as tasks


def take_batches(df: DataFrame, n: int | None, batch: str = "batch_id") -> DataFrame:
    """The first n batches; None for all."""
    return df if n is None else df.filter(F.col(batch) < n)


def one_batch(df: DataFrame, index: int, total: int | None = None, batch: str = "batch_id") -> DataFrame:
    if index < 0 or total is not None and index >= total:
        raise FormatError(f"batch {index} is out of range")
    return df.filter(F.col(batch) == index)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The asked columns in the table's own order; an unknown name is an error."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise FormatError(f"unknown column '{unknown[0]}'")
    return df.select(*(c for c in df.columns if c in columns))


def row_window(df: DataFrame, offset: int, rows: int, row: str = "row_id", total: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + rows`` of each batch."""
    if total is not None:
        check_window(total, offset, rows)
    return df.filter((F.col(row) >= offset) & (F.col(row) < offset + rows))


def with_windows(df: DataFrame, stride: int, row: str = "row_id", name: str = "window_id") -> DataFrame:
    """The number of each row's window of ``stride`` rows."""
    return df.withColumn(name, F.expr(f"cast({row} div {int(stride)} as bigint)"))


def concat_batches(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns by position; names come from the first."""
    if not parts:
        raise FormatError("nothing to concatenate")
    out = parts[0]
    for p in parts[1:]:
        if len(p.columns) != len(out.columns):
            raise FormatError(f"column count {len(p.columns)} differs from {len(out.columns)}")
        out = out.union(p)
    return out


def categorical_codes(df: DataFrame, column: str, order: str, name: str = "code") -> DataFrame:
    """Dictionary codes 0, 1, ... of a column's values in the order of their first appearance; null stays null."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    codes = firsts.select(column, (F.row_number().over(Window.orderBy("_first", column)) - 1).cast("bigint").alias(name))
    return df.join(codes, column, "left").select(*df.columns, name)

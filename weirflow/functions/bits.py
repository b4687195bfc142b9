"""Validity bitmaps and alignment, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(flags: Column) -> Column:
    """array<boolean> -> binary, the first flag in the lowest bit; null counts as false, missing bits are 0."""

    def byte(j: Column) -> Column:
        parts = [F.when(F.coalesce(F.get(flags, j * 8 + k), F.lit(False)), F.lit(1 << k)).otherwise(0) for k in range(8)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return F.lpad(F.hex(total), 2, "0")

    n = F.ceil(F.size(flags) / 8).cast("int")
    return F.when(flags.isNotNull(), F.unhex(F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), byte), "")).otherwise("")))


def unpack_bits(data: Column, n: Column) -> Column:
    """binary -> array<boolean> of the first n bits."""

    def bit(i: Column) -> Column:
        b = F.conv(F.hex(F.substring(data, F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", b, i % 8).bitwiseAND(1) == 1

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), bit)).otherwise(F.array().cast("array<boolean>"))


def aligned(n: Column, to: int = 64) -> Column:
    """The next multiple of ``to``."""
    return n + F.pmod(-n, F.lit(to))

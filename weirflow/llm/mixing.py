"""Mixing sources to target weights by subset-sum budget fitting.

Sources get a share of the corpus's words in proportion to their weights; a source
whose share exceeds ``most`` times its own words stops there and the excess is shared
anew by weight (the fixed point is ``min(most * size, weight * level)`` for one level).

A target is met with whole documents: every document is taken ``floor(target / size of
source)`` times, and the words still missing are fitted exactly: documents are counted by
exact length, each length gets its proportional share of documents, and a bounded-knapsack
dynamic program over (length, how many are left) closes the rest.  Which documents of a
length are taken is decided by a seeded hash.

Scale: texts are read once and never shuffled; what is shuffled is (id, source, size).
The knapsack of a source sees its distinct lengths, at most sqrt(2 * words) of them.  The
documents of one length are ranked within buckets of their hash (``BUCKETS`` of them), so
that a source or a length with a third of all rows is spread over many tasks.

Defined results: a null text has no words and is taken 0 words; a null source is a source
of its own, the last; ids may be null or repeat (each row counts by itself); rows with the same
hash, which have the same id and text, are taken in any order, as they are alike; texts of any
length are counted whole; an empty table gives no rows.  Columns other than doc_id, text and source
are ignored, and may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import cut

WORD = r"[^\x20\x09-\x0D]+"
SEED, BUCKETS, MOST = 17, 1024, 3
#: Words that are left to the dynamic program, if lengths allow it.
RESERVE = 1 << 14


def _hash(seed: int) -> Column:
    """What decides which documents are taken: a hash of id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def sizes(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (the words of each text), _h (its hash)."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), _hash(seed).alias("_h"))


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take so that their words come as near ``budget`` as any
    choice that the dynamic program sees; never more than ``counts``.

    Proportional shares first, then the largest lengths while more than ``reserve`` words are missing,
    then a reachability table over exact sums up to the remaining budget.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    use = lengths > 0
    take[use] = [int(c) * budget // total for c in counts[use]]
    missing = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for k in order:
        size = int(lengths[k])
        if size == 0 or missing <= reserve:
            break
        n = min(int(counts[k] - take[k]), (missing - reserve) // size)
        if n > 0:
            take[k] += n
            missing -= n * size
    # bounded knapsack: bit s of `sums` is set if s words can be made; via[s] = (length's index, pieces) that first made it
    mask = (1 << (missing + 1)) - 1
    sums, via = 1, {}
    for k in order[::-1]:
        size, left = int(lengths[k]), int(counts[k] - take[k])
        if size == 0 or size > missing:
            continue
        left, piece = min(left, missing // size), 1
        while left > 0 and not sums >> missing & 1:
            n = min(piece, left)
            new = (sums << n * size) & mask & ~sums
            sums |= new
            for s in _bits(new):
                via[s] = (k, n)
            left -= n
            piece *= 2
        if sums >> missing & 1:
            break
    s = sums.bit_length() - 1
    while s:
        k, n = via[s]
        take[k] += n
        s -= n * int(lengths[k])
    return take


def _bits(x: int) -> np.ndarray:
    if not x:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def targets(by_source: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size, target: the capped shares of ``by_source`` (source, source_size).

    With sources ordered by ``most * size / weight``, those before the first that stays under its
    cap are capped; the others share what is left by weight.
    """
    everything = Window.partitionBy()  # one row for each source
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    by_cap = everything.orderBy("_ratio", "_n")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_source.withColumn("_n", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_w", w)
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_k", F.row_number().over(by_cap))
        .withColumn("_level", F.min(F.when(F.col("_ratio") * F.col("_open") >= F.col("_left"), F.struct("_k", (F.col("_left") / F.col("_open")).alias("level")))).over(everything)["level"])
        .select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.coalesce(F.col("_level"), F.lit(0.0))).alias("target"))
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(documents: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = MOST, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies, taken (words)."""
    return _planned(documents, weights, most, seed, buckets).drop("_h")


def _planned(documents: DataFrame, weights: Sequence[float], most: float, seed: int, buckets: int) -> DataFrame:
    d = cut(sizes(documents, seed))
    d = d.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(buckets)).cast("int"))
    counted = cut(d.groupBy("source", "size", "_b").agg(F.count(F.lit(1)).alias("n")))
    lengths = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        times = min(int(most), int(target // size)) if size else 0
        rest = int(round(target - times * size)) if times < most else 0
        pdf = pdf.sort_values("size", kind="stable")
        return pdf.assign(times=times, extra=fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), rest))[["source", "size", "n", "source_size", "target", "times", "extra"]]

    joined = lengths.alias("l").join(goal.alias("g"), _same(F.col("l.source"), F.col("g.source"))).select("l.source", "size", "n", "source_size", "target")
    planned = cut(joined.groupBy("source").applyInPandas(plan, "source string, size bigint, n bigint, source_size bigint, target double, times int, extra bigint"))

    # within a length, documents are taken in the order of their hash: whole buckets, and part of one
    run = Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    upto = counted.withColumn("_before", F.coalesce(F.sum("n").over(run), F.lit(0))).alias("c")
    p = planned.alias("p")
    cells = upto.join(p, _same(F.col("c.source"), F.col("p.source")) & (F.col("c.size") == F.col("p.size"))).select("c.source", "c.size", "c._b", "_before", F.col("c.n").alias("n"), "source_size", "target", "times", "extra").alias("c")
    x = d.alias("d").join(cells, _same(F.col("d.source"), F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d._b") == F.col("c._b")))
    x = x.select("d.doc_id", "d.source", "d.size", "d._h", "d._b", "_before", "n", "source_size", "target", "times", "extra")
    rank = F.row_number().over(Window.partitionBy("source", "size", "_b").orderBy("_h", F.col("doc_id").asc_nulls_last()))
    chosen = F.when(F.col("extra") >= F.col("_before") + F.col("n"), True).when(F.col("extra") <= F.col("_before"), False).otherwise(F.col("_before") + rank <= F.col("extra"))
    copies = (F.col("times") + F.when(chosen, 1).otherwise(0)).cast("int")
    return x.select("doc_id", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", copies.alias("copies"), (F.col("size") * copies).cast("bigint").alias("taken"), "_h")


def mixed(documents: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = MOST, seed: int = SEED) -> DataFrame:
    """``documents`` with each row as often as the mix takes it.

    Of rows with the same id and text (ids may be null), one stands for all as often as they are taken together.
    """
    plan = _planned(documents, weights, most, seed, BUCKETS).groupBy("doc_id", "_h").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    p = cut(plan.filter("copies > 0")).alias("p")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), _hash(seed).alias("h")).alias("d")
    x = rows.join(p, (F.col("d.h") == F.col("p._h")) & _same(F.col("d.row.doc_id"), F.col("p.doc_id"))).select("row", "h", F.col("row.doc_id").alias("id"), "copies", "n")
    if not p.filter("n > 1").isEmpty():
        x = x.filter("n = 1").unionByName(x.filter("n > 1").dropDuplicates(["h", "id"]))
    return x.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

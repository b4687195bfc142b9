"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Tables, cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reached) of every end of an edge (a, b: bigint).

    A round links each node's larger neighbours to its smallest neighbour, then each node and its
    smaller neighbours to the smallest of them.  Minima are pre-aggregated and joined back from a
    written table, so a node with very many neighbours is never gathered in one task.  Rounds end
    when the edges no longer change, after a number that grows with the logarithm of the longest path.
    """
    tables = Tables(edges.sparkSession, "components")
    e = tables.put(edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    before, old = None, 0
    for _ in range(most_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tables.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = tables.put(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = tables.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = tables.put(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        tables.drop(old, tables.n - 1)
        old = tables.n - 1
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError("components did not settle")
    e = cut(e)
    tables.close()
    pairs = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

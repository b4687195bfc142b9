"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become rows of integers; a component is a term.  Candidates are packed into blocks;
of a block, each term's postings are the rows that hold it and their weights.  A block of
queries scatters its weighted postings, term after term, into dense score arrays (one cell per
query and candidate), of which a partition selection takes the k best; results of blocks and
then of tasks are merged.  Scores are exact integers.

Scale: nothing is broadcast.  Blocks of queries meet blocks of candidates in tasks keyed by
(query block, share of the candidates); a task keeps k rows per query, whatever its share.  Candidates
are copied once for each ``QUERY_BLOCK`` queries, in the narrowest integers that hold them.

Defined results: vectors that are null, or hold null or non-finite components, and rows without
an id take no part; vectors of another length than the query's are no candidates of it.  Repeated
rows are candidates of their own (also of each other).  Ties go to the smaller id.  Components of any
finite size are summed exactly; a sum beyond 64 bits counts as the nearest 64-bit integer.  Very long
vectors are handled like others, in fewer rows at a time.  An empty
table has no results.  Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import cut

#: Rows of a candidate block; queries scored at a time; queries that share a copy of the candidates; candidate blocks a task reads at most.
BLOCK, QUERIES, QUERY_BLOCK, BLOCKS_A_TASK = 2048, 128, 4096, 256
#: Components of a block at most (one vector may have more).
COMPONENTS = 1 << 20
_PACKED = "block bigint, dim int, n int, ids binary, code string, vals binary"


def _rows_of(dim: int, rows: int) -> int:
    return max(1, min(rows, COMPONENTS // max(dim, 1)))


def _narrow(vals: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest of the types int16, int32, int64 and (beyond these) float64."""
    most = float(np.abs(vals).max(initial=0))
    for kind, bound in ((np.int16, 2.0**15), (np.int32, 2.0**31), (np.int64, 2.0**63)):
        if most < bound:
            return vals.astype(kind)
    return vals


def _matrix(r: dict) -> np.ndarray:
    return np.frombuffer(r["vals"], r["code"]).reshape(r["n"], r["dim"])


def pack(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """Blocks of valid vectors of one length: block, dim, n, ids (int64), vals (n x dim numbers of type code: floor(scale * x))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, ids: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            order = np.argsort(ids, kind="stable")
            x = _narrow(vals[order])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([x.dtype.str]), pa.array([np.ascontiguousarray(x).tobytes()])],
                ["block", "dim", "n", "ids", "code", "vals"],
            )

        for b in batches:
            ids, vec = b.column("vec_id"), b.column("embedding")
            size = np.where(np.asarray(vec.is_null()), -1, np.asarray(pa.compute.list_value_length(vec).fill_null(0)))
            flat = vec.flatten().cast(pa.float64())
            bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
            n_bad = np.concatenate([[0], np.cumsum(bad)])
            good = (size >= 0) & (n_bad[starts[1:]] == n_bad[starts[:-1]]) & np.asarray(ids.is_valid())
            with np.errstate(over="ignore"):
                most = np.finfo(float).max
                values = np.clip(np.floor(scale * flat.fill_null(0.0).to_numpy(zero_copy_only=False)), -most, most)
            values = np.where(bad, 0, values)
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size[good]):
                rows = np.flatnonzero(good & (size == dim))
                x = values[starts[rows][:, None] + np.arange(dim)]
                have = waiting.setdefault(int(dim), [])
                have.append((key[rows], x))
                most = _rows_of(int(dim), BLOCK)
                if sum(len(k) for k, _ in have) >= most:
                    k, v = np.concatenate([h[0] for h in have]), np.concatenate([h[1] for h in have])
                    whole = len(k) // most * most
                    for i in range(0, whole, most):
                        yield block(int(dim), k[i : i + most], v[i : i + most])
                    have[:] = [(k[whole:], v[whole:])]
        for dim, have in waiting.items():
            k, v = np.concatenate([h[0] for h in have]), np.concatenate([h[1] for h in have])
            if len(k):
                yield block(dim, k, v)

    return vectors.selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<double>) embedding").mapInArrow(run, _PACKED)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), one term after another; 32-bit cells where they surely hold the sums,
    and sums of any size where 64 bits may not."""
    dim = queries.shape[1]
    bound = dim * (int(np.abs(queries.astype(float)).max(initial=0)) * int(np.abs(candidates.astype(float)).max(initial=0)))
    if bound >= 1 << 62:  # (the bound is rounded)
        whole = np.vectorize(int, otypes=[object])
        return np.clip(whole(queries) @ whole(candidates).T if dim else np.zeros((len(queries), len(candidates)), object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
    kind = np.int32 if bound < 1 << 31 else np.int64
    q, c = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    scores = np.zeros((len(queries), len(candidates)), dtype=kind)
    scratch = np.empty_like(scores)
    for t in range(dim):
        rows, postings = np.flatnonzero(q[:, t]), np.flatnonzero(c[t])
        if len(rows) == len(q) and len(postings) == len(candidates):
            np.multiply.outer(q[:, t], c[t], out=scratch)
            scores += scratch
        elif len(rows) and len(postings):
            scores[np.ix_(rows, postings)] += np.multiply.outer(q[rows, t], c[t, postings])
    return scores


def _joined(blocks: list[np.ndarray]) -> np.ndarray:
    """The blocks under each other; integers stay integers beside floats that hold larger ones."""
    kinds = {b.dtype for b in blocks}
    return np.concatenate(blocks) if not any(k.kind == "f" for k in kinds) or len(kinds) == 1 else np.concatenate([np.vectorize(int, otypes=[object])(b) for b in blocks])


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column indexes of the k highest scores of each row; of equal scores the first columns. Unordered."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    key = scores.astype(np.int64)
    if max(int(key.max(initial=0)), -int(key.min(initial=0))) < (1 << 62) // n:
        key = key * n - np.arange(n)
        return np.argpartition(key, n - k, axis=1)[:, n - k :]
    return np.argsort(~key, axis=1, kind="stable")[:, :k]


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    blocks = cut(pack(vectors, scale))
    shape = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    query_blocks = max(1, math.ceil(shape["rows"] / every / QUERY_BLOCK))
    shares = max(1, math.ceil(shape["blocks"] / BLOCKS_A_TASK), min(shape["blocks"], math.ceil(24 / query_blocks)))

    def queries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    vals = _matrix(r)[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["block"]]), pa.array([r["dim"]], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([ids[at].tobytes()]), pa.array([r["code"]]), pa.array([np.ascontiguousarray(vals).tobytes()]), pa.array([at.astype(np.int64).tobytes()])],
                        ["block", "dim", "n", "ids", "code", "vals", "at"],
                    )

    asked = blocks.mapInArrow(queries_of, _PACKED + ", at binary").withColumn("qb", F.pmod(F.xxhash64("block"), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("kind", F.lit(0))
    offered = blocks.withColumn("at", F.lit(None).cast("binary")).withColumn("share", F.pmod(F.hash("block"), F.lit(shares)).cast("int"))
    offered = offered.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("kind", F.lit(1))
    cols = ["dim", "qb", "share", "kind", "block", "n", "ids", "code", "vals", "at"]
    met = asked.select(cols).unionByName(offered.select(cols)).repartition("dim", "qb", "share").sortWithinPartitions("dim", "qb", "share", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, state = None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if state is not None and len(state["score"]):
                s = state
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["q_block"][s["q"]]), pa.array(s["q_at"][s["q"]]), pa.array(s["q_id"][s["q"]]), pa.array(s["id"]), pa.array(s["score"])], ["q_block", "q_at", "query_id", "vec_id", "score"]
                )

        for b in batches:
            for r in b.to_pylist():
                now = (r["dim"], r["qb"], r["share"])
                if now != key:
                    yield from flush()
                    key, asked, state = now, [], None
                if r["kind"] == 0:
                    asked.append(r)
                    continue
                if not asked:
                    continue
                if state is None:
                    ids = [np.frombuffer(a["ids"], np.int64) for a in asked]
                    none = np.zeros(0, np.int64)
                    state = {
                        "q_id": np.concatenate(ids), "q_at": np.concatenate([np.frombuffer(a["at"], np.int64) for a in asked]), "q_block": np.concatenate([np.full(len(i), a["block"]) for i, a in zip(ids, asked, strict=True)]),
                        "v": _joined([_matrix(a) for a in asked]), "q": none, "id": none, "score": none,
                    }
                s, n = state, r["n"]
                cand, cand_id = _matrix(r), np.frombuffer(r["ids"], np.int64)
                found = []
                for i in range(0, len(s["q_id"]), QUERIES):
                    scores = accumulate(s["v"][i : i + QUERIES], cand).astype(np.int64)
                    own = np.flatnonzero(s["q_block"][i : i + QUERIES] == r["block"])
                    picked = best(scores, k + 1)  # one more, in case the query itself is among them
                    q = np.repeat(np.arange(len(scores)), picked.shape[1])
                    c = picked.ravel()
                    keep = np.ones(len(c), dtype=bool)
                    if len(own):
                        at = np.full(len(scores), -1)
                        at[own] = s["q_at"][i : i + QUERIES][own]
                        keep = c != at[q]
                    found.append((q[keep] + i, cand_id[c[keep]], scores[q[keep], c[keep]]))
                s["q"], s["id"], s["score"] = (np.concatenate([old, *new]) for old, new in zip((s["q"], s["id"], s["score"]), zip(*found, strict=True), strict=True))
                order = np.lexsort((s["id"], ~s["score"], s["q"]))
                first = np.searchsorted(s["q"][order], s["q"][order])
                order = order[np.arange(len(order)) - first < k]
                s["q"], s["id"], s["score"] = s["q"][order], s["id"][order], s["score"][order]
        yield from flush()

    found = met.mapInArrow(run, "q_block bigint, q_at bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_at").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

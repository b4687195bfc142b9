"""Exact search at the ends of 64 bits, with long vectors and over many blocks of queries."""

import math

import numpy as np
import pytest

from weirflow.llm import topk


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i % every == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, block string, n int").repartition(3)
    assert sorted(map(tuple, topk.search(df).collect())) == brute(rows)


def test_sums_beyond_64_bits(spark):
    big = [1e300, -1e300, 1e17, -1e17, 9e15, 3.5, 0.0, -2.0, 2.0**52, float("inf"), float("nan"), None]
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [(k, [big[rng.integers(len(big) - (k % 7 != 0) * 3)] for _ in range(3)]) for k in range(0, 1500, 25)] + [(100, None), (None, [1.0, 2.0, 3.0]), (200, []), (300, [])]
    check(spark, rows)


@pytest.mark.parametrize("dim", [1, 7])
def test_many_blocks(spark, monkeypatch, dim):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BLOCK", 11)
    rng = np.random.Generator(np.random.PCG64(dim))
    check(spark, [(int(k), rng.integers(-2, 3, dim).astype(float).tolist()) for k in rng.permutation(np.r_[0:900:10, 0:300:100])])


def test_very_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "COMPONENTS", 1000)
    rng = np.random.Generator(np.random.PCG64(1))
    check(spark, [(k * 50, rng.normal(size=3000).tolist()) for k in range(12)])


def test_narrow_types():
    assert [topk._narrow(np.array([x])).dtype.kind + str(topk._narrow(np.array([x])).dtype.itemsize) for x in (32767.0, 32768.0, 2.0**40, 2.0**63, 1e300)] == ["i2", "i4", "i8", "f8", "f8"]

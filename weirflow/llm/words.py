"""Vectorised word kernel shared by the text operators.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All of these
bytes are ASCII, so cutting the UTF-8 bytes gives exactly the words of the text.
Everything works straight on the Arrow buffers of a batch: no Python object is
made per word.  Hashes are 64-bit polynomials over a random byte table (mod 2^64,
odd base) passed through a bijective finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from ..shared import shared_top

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Bytes hashed at a time; bounds the kernel's temporary arrays whatever the text's length.
BLOCK = 1 << 19
#: Text bytes in one slice of a batch (a longer single text is a slice of its own).
SLICE = 1 << 20


def _powers(base: int, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of ``base`` and of its inverse mod 2^64, at least ``n`` of each."""
    have = cache.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = cache[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each pair."""
    n = len(values)
    up, down = _powers(base, n + 1)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=pre[1:])
    return (pre[ends] - pre[starts]) * down[starts]


class Words:
    """The words of a slice of texts.

    data    the bytes; lo, hi  byte span of each word; doc  its text's index
    first   index of each text's first word; count  words of each text
    """

    __slots__ = ("count", "data", "doc", "first", "hi", "lo", "n_docs", "spans")

    def __init__(self, texts: pa.Array):
        self.n_docs = len(texts)
        self.data, offsets = text_bytes(texts)
        self.spans = offsets
        if len(self.data) == 0:
            self.lo = self.hi = np.zeros(0, dtype=np.int64)
            self.doc = np.zeros(0, dtype=np.int64)
            self.first = self.count = np.zeros(self.n_docs, dtype=np.int64)
            return
        inside = ~SPACE[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(inside))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.lo = np.flatnonzero(begins)
        self.hi = np.flatnonzero(ends) + 1
        cuts = np.searchsorted(self.lo, offsets)
        self.first, self.count = cuts[:-1], np.diff(cuts)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.lo), dtype=np.uint64)
        i = 0
        while i < len(self.lo):
            j = max(i + 1, int(np.searchsorted(self.hi, self.lo[i] + BLOCK, side="right")))
            at, to = self.lo[i], self.hi[j - 1]
            out[i:j] = _rolling(_BYTE[self.data[at:to]], self.lo[i:j] - at, self.hi[i:j] - at, _BASES[0])
            i = j
        return mix(out)

    def windows(self, hashes: np.ndarray, width: int, at: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of the ``width`` words that start at each word index in ``at`` (ascending)."""
        out = np.empty(len(at), dtype=np.uint64)
        base = _BASES[1 + salt % 2]
        step = BLOCK // 4
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(at, at[i] + step)))
            low, high = at[i], at[j - 1] + width
            rel = at[i:j] - low
            out[i:j] = _rolling(hashes[low:high], rel, rel + width, base)
            i = j
        return mix(out, salt + 1)

    def texts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each text's word sequence."""
        ends = self.first + self.count
        n = self.count.astype(np.uint64)
        return tuple(mix(_rolling(hashes, self.first, ends, _BASES[1 + salt]) + n, salt + 3) for salt in (0, 1))

    def starts(self, width: int) -> np.ndarray:
        """Word indexes at which ``width`` words of one text start."""
        if not len(self.lo):
            return np.zeros(0, dtype=np.int64)
        left = np.repeat(self.first + self.count, self.count) - np.arange(len(self.lo))
        return np.flatnonzero(left >= width)

    def words_of(self, doc: int) -> list[bytes]:
        f, n = self.first[doc], self.count[doc]
        raw = self.data
        return [raw[a:b].tobytes() for a, b in zip(self.lo[f : f + n], self.hi[f : f + n], strict=True)]

    def text_of(self, doc: int) -> bytes:
        return self.data[self.spans[doc] : self.spans[doc + 1]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts and their offsets from 0; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if texts.type == pa.large_string() else np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have at most ``most`` bytes, or are one text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def shared_folder(spark, name: str) -> str:
    """A fresh folder for ``name`` under ``spark.checkpoint.dir``, which driver and executors share."""
    import uuid

    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df):
    """``df.checkpoint()`` in the shared folder: cuts the lineage and survives lost executors.

    Its shuffle files go as soon as the checkpoint is written, and older checkpoints that nothing refers
    to any more when the driver collects its garbage, which is asked for here.
    """
    import gc

    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_top(spark))
    with files_removed(spark):
        out = df.select("*").checkpoint(True)  # a new plan, which takes the setting up
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


@contextmanager
def files_removed(spark) -> Iterator[None]:
    """Within it, a query's shuffle files go when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Tables:
    """Written tables of a loop, in the shared folder.

    A checkpoint hands on its plan's partitioning and constraints, which double with every round of a
    loop; a table that is read again has neither.
    """

    def __init__(self, spark, name: str):
        self.spark, self.folder, self.n = spark, shared_folder(spark, name), 0

    def put(self, df):
        path = f"{self.folder}/{self.n}"
        self.n += 1
        with files_removed(self.spark):
            df.select("*").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, first: int, last: int) -> None:
        """Removes the tables numbered from first to before last."""
        for k in range(first, last):
            self._delete(f"{self.folder}/{k}")

    def close(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def sum_vectors(parts, spread: int = 32):
    """Sums of rows (k int, v binary: float64 values) by k, in two rounds so that no task reads a row of every other one.

    What comes out is as large as one task's own vectors.  Returns a dict of numpy arrays.
    """
    from pyspark.sql import functions as F

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer(), dtype=np.float64)
                total[k] = total[k] + x if k in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["k", "v"])

    first = parts.withColumn("_s", F.spark_partition_id() % spread).repartition(F.col("k"), F.col("_s")).select("k", "v").mapInArrow(add, "k int, v binary")
    rows = first.repartition(F.col("k")).mapInArrow(add, "k int, v binary").collect()
    return {r["k"]: np.frombuffer(bytes(r["v"]), dtype=np.float64) for r in rows}

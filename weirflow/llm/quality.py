"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a few dozen statistics (lengths, classes of characters, repeats, shapes of
words and lines), all from whole texts.  Standardised, they pass through random Fourier
features, whose inner products approximate a Gaussian kernel; the ridge solution comes from
normal equations that every partition sums by itself (``Z'Z`` and ``Z'y`` of a fixed size, so
nothing that goes to the driver grows with the table).  Raw scores are calibrated by pooling
adjacent violators over a fixed number of score bins.  Labelled rows are all used.

Defined results: a null or empty text has zero statistics and is scored like any other; without
labelled rows, every score is 0.5; with labels of one class only, scores lean to that class.
Repeated rows are scored each by itself; repeated labels of an id count by their mean; rows with
a null id are scored but never learnt from.  Columns other than doc_id and text are ignored, whatever
their names.  Texts are read whole, however long, in slices of bounded size or one text each; equal raw
scores get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, cut, slices, sum_vectors

#: Random features, their seed, ridge penalty per row, bins of the calibration, labelled rows a task sums.
FEATURES, SEED, RIDGE, BINS, ROWS_A_TASK = 256, 5, 1e-4, 4096, 50_000

# Classes of bytes.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x80:] = 1
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".,;:?'\"()-", "!", "|", "#$%&*@^~_=+<>{}[]\\`/"), 2):
    _CLASS[[ord(c) for c in _chars]] = _k
N_CLASSES = 11
_SYMBOL = np.isin(_CLASS, (8, 9, 10))
_UPPER = _CLASS == 3
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".?!:;,"]] = True
NAMES = (
    ["log_bytes", "log_words", "word_len", "word_len_sd", "long_words", "short_words", "symbol_words", "capital_words", "stopped_words", "distinct_words", "top_word", "same_as_last", "same_as_second_last", "distinct_trigrams", "words_a_line", "log_lines", "byte_entropy"]
    + [f"class_{k}" for k in range(N_CLASSES)]
)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, how many distinct keys it has and how often its most frequent one stands."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    w = Words(texts)
    n = w.n_docs
    out = np.zeros((n, len(NAMES)))
    if not len(w.data):
        return out
    size = np.diff(w.spans)
    cls = _CLASS[w.data]
    which = np.repeat(np.arange(n), size)
    counts = np.bincount(which * N_CLASSES + cls, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    words = np.maximum(w.count, 1)
    length = w.hi - w.lo
    mean = np.bincount(w.doc, weights=length, minlength=n) / words
    square = np.bincount(w.doc, weights=length.astype(float) ** 2, minlength=n) / words

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=flag, minlength=n) / words

    def inside(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[w.data])])
        return c[w.hi] - c[w.lo]

    h = w.hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    second = np.zeros(len(h), dtype=bool)
    second[2:] = (h[2:] == h[:-2]) & (w.doc[2:] == w.doc[:-2])
    distinct, most = _distinct(h, w.doc, n)
    at = w.starts(3)
    trigrams, _ = _distinct(w.windows(h, 3, at), w.doc[at], n)
    hist = np.bincount(which * 64 + (w.data & 63), minlength=n * 64).reshape(n, 64) / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(hist > 0, hist * np.log(hist), 0.0), axis=1)
    lines = counts[:, 6] + 1
    columns = [
        np.log1p(size), np.log1p(w.count), mean, np.sqrt(np.maximum(square - mean**2, 0)), share(length > 12), share(length <= 3), share(inside(_SYMBOL) > 0), share(inside(_UPPER) >= 2),
        share(_STOP[w.data[w.hi - 1]] if len(w.hi) else np.zeros(0)), distinct / words, most / words, share(same), share(second), np.where(w.count >= 3, trigrams / np.maximum(w.count - 2, 1), 1.0), np.log1p(w.count / lines), np.log1p(lines), entropy,
    ]
    out[:, : len(columns)] = np.stack(columns, axis=1)
    out[:, len(columns) :] = counts / np.maximum(size, 1)[:, None]
    out[size == 0] = 0
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _unused(name: str, taken: list[str]) -> str:
    """The name, with as many underscores more as make it differ from all taken ones."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def featurize(documents: DataFrame) -> DataFrame:
    """doc_id, f: the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(statistics(b.column("text")))], ["doc_id", "f"])

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, f array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Fourier:
    """Standardises statistics and maps them to random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        d = len(mean)
        self.mean, self.scale = mean, np.where(sd > 1e-9, 1 / np.maximum(sd, 1e-9), 0.0)
        self.w = rng.normal(size=(d, features)) / math.sqrt(d)  # a kernel as wide as standardised rows are far apart
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -4, 4)
        f = np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b))
        return np.concatenate([f, np.ones((len(f), 1))], axis=1)


def pool(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to means ``y`` with weights ``n``: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for mean, weight in zip(y, n, strict=True):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, k, c = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + m * k) / (b[1] + k), b[1] + k, b[2] + c
    return np.concatenate([np.full(int(c), m) for m, _, c in blocks]) if blocks else np.zeros(0)


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None):
        self.fourier, self.weights = fourier, weights
        self.x = self.y = np.zeros(0)

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.fourier(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(f), 0.5)
        raw = self.raw(f)
        return np.clip(np.interp(raw, self.x, self.y) if len(self.x) else raw, 0, 1)


def fit(learn: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS) -> Model:
    """A model from rows (f, y), y between 0 and 1."""
    d = len(NAMES)
    got = learn.agg(F.count("*").alias("n"), *(f(F.col("f")[k]).alias(f"{a}{k}") for k in range(d) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n = got["n"]
    if not n:
        return Model(None, None)
    fourier = Fourier(np.array([got[f"m{k}"] for k in range(d)]), np.array([got[f"s{k}"] for k in range(d)]), features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                z = fourier(_matrix(part.column("f")))
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ part.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["k", "v"])

    tasks = max(1, math.ceil(n / ROWS_A_TASK))
    got = sum_vectors(learn.select("f", "y").coalesce(tasks).mapInArrow(sums, "k int, v binary"))
    total = np.stack([got[k] for k in range(features + 1)])
    model = Model(fourier, np.linalg.solve(total[:, :-1] + ridge * n * np.eye(features + 1), total[:, -1]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw(_matrix(b.column("f")))
            k = np.clip(np.floor((raw + 1) / 3 * bins), 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw), b.column("y")], ["k", "raw", "y"])

    rows = learn.select("f", "y").mapInArrow(binned, "k int, raw double, y double").groupBy("k").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("k").toPandas()
    model.x, model.y = rows["x"].to_numpy(), pool(rows["y"].to_numpy(), rows["n"].to_numpy())
    return model


def _learn(f: DataFrame, labels: DataFrame, label: str, keep) -> Model:
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    return fit(cut(f.filter(F.col("doc_id").isNotNull() & keep).join(y, "doc_id").select("f", "y")))


def score(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows with ``crc32(doc_id) mod folds = held`` are never learnt from."""
    f = cut(featurize(documents))
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = _learn(f, labels, label, fold != held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = model.score(_matrix(b.column("f")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = f.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``documents``, unchanged, whose score is at least ``least``.

    Statistics are computed once and kept beside their rows in a checkpoint, which learning and filtering
    read; no text is shuffled.
    """
    held_in = _unused("_stats", documents.columns)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    schema = T.StructType([*documents.schema.fields, T.StructField(held_in, T.ArrayType(T.DoubleType()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.append_column(held_in, _lists(statistics(b.column("text"))))

    rows = cut(documents.mapInArrow(describe, schema))
    model = _learn(rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(held_in).alias("f")), labels, label, fold != held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = b.filter(pa.array(model.score(_matrix(b.column(held_in))) >= least))
                yield good.drop_columns([held_in])

    return rows.mapInArrow(run, documents.schema)

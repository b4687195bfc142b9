"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased; a character that is no letter counts as a blank; n-grams of one to three
characters with at least one letter are hashed into ``2**BITS`` columns.  The weight of a column
is its share of the text's n-grams times its inverse document frequency, which is counted over
all learnable documents.  The model is trained on the driver by follow-the-regularised-leader
(per-coordinate steps, elastic-net penalties, so that most weights stay exactly zero) on at most
``SAMPLE`` documents chosen by a hash of their ids; a part of them is held back to fit the
temperature that calibrates the probabilities.

Defined results: a null text, or one without a letter, is ``und`` with score 0.  Null labels and
null ids are not learnt from.  Without anything to learn, every text is ``und``.  Of equal scores
the language that sorts first wins.  Whole texts of any length are read, a slice at a time.
Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import sum_vectors

BITS, ORDERS = 16, (1, 2, 3)
#: Labelled documents that train and calibrate the model at most, and passes over them.
SAMPLE, PASSES = 3000, 4
#: FTRL: step size and offset, penalties on absolute values and squares; factor on TF-IDF values.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.001, 8.0
#: Characters of one text handled at a time.
SPAN = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> Iterator[np.ndarray]:
    """Columns of the n-grams of the text, a span of it at a time."""
    letters = _letters()
    low = text.lower()
    for i in range(0, len(low), SPAN):
        c = np.frombuffer(low[max(0, i - max(ORDERS) + 1) : i + SPAN].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        skip = min(i, max(ORDERS) - 1)
        is_letter = letters[c]
        c = np.where(is_letter, c, np.uint32(32))
        out = []
        h, any_letter = np.zeros(len(c), dtype=np.uint32), np.zeros(len(c), dtype=bool)
        for n in ORDERS:
            # the n-gram that ends at each character: one more character on its left
            left = np.full(len(c), 32, dtype=np.uint32)
            left[n - 1 :] = c[: len(c) - n + 1] if n > 1 else c
            seen = np.zeros(len(c), dtype=bool)
            seen[n - 1 :] = is_letter[: len(c) - n + 1] if n > 1 else is_letter
            h = (h ^ left) * np.uint32(0x9E3779B1) + np.uint32(n)
            h ^= h >> np.uint32(15)
            any_letter = any_letter | seen
            out.append((h[skip:] * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS))[any_letter[skip:]])
        yield np.concatenate(out)


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero columns of a text and their values."""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for g in grams(text or ""):
        counts += np.bincount(g, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, SCALE * counts[at] / max(1, counts.sum()) * idf[at]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        shape = (1 << BITS, len(langs))
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0
        self.table: np.ndarray | None = None

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> None:
        rng = np.random.Generator(np.random.PCG64(3))
        for _ in range(passes):
            for k in rng.permutation(len(rows)):
                at, x, y = rows[k]
                w = self.weights(at)
                p = _softmax((x @ w + self.bias)[None])[0]
                p[y] -= 1
                g = x[:, None] * p
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
                self.n[at] = n + g * g
                self.bias -= 0.02 * p

    def finish(self, held: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        w = self.weights()
        if held:
            logits = np.array([x @ w[at] + self.bias for at, x, _ in held])
            y = np.array([y for *_, y in held])
            grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
            loss = [-np.mean(np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12))) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        self.table = (SCALE * self.idf[:, None] * w).astype(np.float32)
        self.z = self.n = None

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.langs)), 0
        if text and self.langs:
            for g in grams(text):
                total += self.table.take(g, axis=0).sum(axis=0, dtype=np.float64)
                n += len(g)
        if not n:
            return UNKNOWN, 0.0
        p = _softmax(((total / n + self.bias) / self.temperature)[None])[0]
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, p[k]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(learn: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents there are and in how many each column stands; a task sends one row for each block of columns."""
    width = 1 << 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(1 << BITS, dtype=np.int64), 0, np.zeros(1 << BITS, dtype=np.uint8)
        for b in batches:
            for text in b.column("text").to_pylist():
                found = list(grams(text or ""))
                for g in found:
                    seen[g] = 1
                df += seen
                for g in found:
                    seen[g] = 0
                n += 1
        rows = np.concatenate([df, [n], np.zeros(width - 1)]).astype(np.float64).reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["k", "v"])

    got = sum_vectors(learn.select("text").mapInArrow(run, "k int, v binary"))
    if not got:
        return 0, np.zeros(1 << BITS)
    total = np.concatenate([got[k] for k in sorted(got)])
    return int(total[1 << BITS]), total[: 1 << BITS]


def fit(learn: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, lang)."""
    n, df = document_frequencies(learn)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.05, 0.0)
    # the smallest hashes are found on ids alone, so that no task gathers other partitions' texts
    h = F.xxhash64("doc_id")
    last = learn.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], idf)
    rows = learn.filter(h <= last).select("doc_id", "text", "lang").dropDuplicates(["doc_id"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [vector(t, idf) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([at.astype(np.int32).tobytes() for at, _ in v]), pa.array([x.astype(np.float32).tobytes() for _, x in v])], ["doc_id", "lang", "at", "x"])

    got = sorted(rows.mapInArrow(vectors, "doc_id bigint, lang string, at binary, x binary").collect(), key=lambda r: r["doc_id"])
    langs = sorted({r["lang"] for r in got})
    data = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), langs.index(r["lang"])) for r in got if len(r["at"])]
    model = Model(langs, idf)
    held = data[::6] if len(data) >= 60 else []
    model.train([x for k, x in enumerate(data) if k % 6 or not held])
    model.finish(held)
    return model


def identify(documents: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows with ``crc32(doc_id) mod folds = held`` are never learnt from."""
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != held)), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = [model.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score")

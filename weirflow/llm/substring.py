"""Substring dedup with difference-cover anchors.

A window of ``width`` words is a duplicate if its word sequence also starts in a document with a
smaller id.  Words are hashed into anchors only at positions of a difference cover: for any two
positions i, j there is a shift below the period that brings both into the cover, so two equal
windows share an anchor of ``width - period + 1`` words at the same place inside them.  Anchors
that stand in one distinct text only are dropped.  Around the others, windows are extended to
their full width and hashed to 128 bits; each is held against the smallest id that has it.

Documents with the same words are one class; only the class's smallest id goes through the
windows, the others are removed whole (if they are a window long at all).

Scale: one shuffle of anchors (cover size / period of the words, each one number) with map-side
minimum and maximum, joins from tables that are written first, so that large keys can be split,
and per document at most one list as long as the document.  No group of documents is gathered.

Defined results: a null text has no words; texts shorter than a window lose nothing; a row with a
null id loses nothing and takes nothing from others; rows that repeat an id do not count against
each other; windows are judged on the input, not on what is left.  Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, as_long, cut, mix, slices

#: Words of a window; period and positions of the cover (every difference modulo 31 occurs once).
WIDTH, PERIOD, COVER = 50, 31, (0, 1, 3, 8, 12, 18)


def check_cover(period: int, cover: tuple[int, ...]) -> None:
    if len({(a - b) % period for a in cover for b in cover}) != period:
        raise ValueError("not a difference cover: some difference is missing")


def _inside(w: Words, width: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Word indexes at which an anchor starts: cover positions of texts that have a window."""
    span = width - period + 1
    at = w.starts(span)
    d = w.doc[at]
    return at[np.isin((at - w.first[d]) % period, cover) & (w.count[d] >= width)]


def _anchors(docs: DataFrame, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    span = width - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            h = w.hashes()
            c1, c2 = w.texts(h)
            at = _inside(w, width, period, cover)
            a, d = w.windows(h, span, at), w.doc[at]
            order = np.lexsort((a, d))
            a, d = a[order], d[order]
            if len(a):
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
                a, d = a[new], d[new]
            ends = np.searchsorted(d, np.arange(w.n_docs + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), as_long(c1), as_long(c2), pa.array(w.count), pa.ListArray.from_arrays(pa.array(ends), as_long(a))], ["doc_id", "c1", "c2", "n_words", "anchors"]
            )

    return docs.mapInArrow(run, "doc_id bigint, c1 bigint, c2 bigint, n_words bigint, anchors array<bigint>")


def _windows(docs: DataFrame, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(doc_id, text, anchors) -> every window with one of the anchors in its first ``period`` words: doc_id, c1, at, w1, w2."""
    span = width - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            h = w.hashes()
            c1, _ = w.texts(h)
            at = _inside(w, width, period, cover)
            a, d = w.windows(h, span, at), w.doc[at]
            # (document, anchor) pairs that are wanted
            lists = b.column("anchors")
            want = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(w.n_docs), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
            hit = np.isin(mix(a ^ mix(d.astype(np.uint64), 9)), mix(want ^ mix(of.astype(np.uint64), 9)))
            # windows that start up to period - 1 words before a wanted anchor and end inside the text
            marks = np.zeros(len(h) + 1, dtype=np.int64)
            first = np.maximum(at[hit] - period + 1, w.first[d[hit]])
            np.add.at(marks, first, 1)
            np.add.at(marks, at[hit] + 1, -1)
            covered = np.cumsum(marks[:-1]) > 0
            begin = w.starts(width)
            begin = begin[covered[begin]]
            for i in range(0, len(begin), 1 << 17):
                s = begin[i : i + (1 << 17)]
                k = w.doc[s]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(k)), as_long(c1[k]), pa.array((s - w.first[k]).astype(np.int32)), as_long(w.windows(h, width, s, 0)), as_long(w.windows(h, width, s, 1))], ["doc_id", "c1", "at", "w1", "w2"]
                )

    return docs.mapInArrow(run, "doc_id bigint, c1 bigint, at int, w1 bigint, w2 bigint")


def _apply(docs: DataFrame, width: int, with_text: bool) -> DataFrame:
    """(doc_id, text, rest, found: list of (c1, whole, starts)) -> what is kept; ``rest`` is passed on."""
    import hashlib

    rest = docs.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = b.column("found").to_pylist()
            w = None
            rows = []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if found[i]:
                    if w is None:
                        w = Words(b.column("text"))
                        c1 = w.texts(w.hashes())[0].view(np.int64)
                    mine = [x for x in found[i] if x["c1"] == c1[i]]
                    if any(x["whole"] for x in mine):
                        words = []
                    elif mine:
                        marks = np.zeros(n + 1, dtype=np.int64)
                        for x in mine:
                            s = np.array(x["starts"], dtype=np.int64)
                            np.add.at(marks, s, 1)
                            np.add.at(marks, np.minimum(s + width, n), -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text and n != len(words) else text if with_text else None))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, b.column("rest")], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "rest"])

    return docs.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, rest {rest}")


def dedup(documents: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (words left, joined by one space), kept, rest.

    ``rest`` holds the row's other columns as a struct.  ``kept`` is filled only ``with_text``: the words left joined by one space, or the text as it
    was if nothing is removed.
    """
    check_cover(period, cover)
    if not 0 < period < width:
        raise ValueError("the period must be smaller than the window")
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("rest"))
    known = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    a = cut(_anchors(known, width, period, cover).filter(F.col("n_words") >= width))
    owners = cut(a.groupBy("c1", "c2").agg(F.min("doc_id").alias("owner")))
    each = a.select("doc_id", "c1", F.explode("anchors").alias("h"))
    shared = cut(each.groupBy("h").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).filter("lo <> hi").select("h"))
    hits = each.select("doc_id", "h").join(shared, "h", "left_semi")
    lists = cut(hits.groupBy("doc_id").agg(F.collect_set("h").alias("anchors")).join(owners.select(F.col("owner").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    del each, hits, shared
    w = cut(_windows(known.join(lists, "doc_id"), width, period, cover))
    firsts = cut(w.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("w1", "w2", "lo"))
    later = w.join(firsts, ["w1", "w2"]).filter("doc_id > lo")
    parts = later.groupBy("doc_id", "c1").agg(F.collect_set("at").alias("starts")).select("doc_id", F.struct("c1", F.lit(False).alias("whole"), "starts").alias("x"))
    copies = a.select("doc_id", "c1", "c2").join(owners, ["c1", "c2"]).filter("doc_id > owner")
    copies = copies.select("doc_id", F.struct("c1", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")).alias("x"))
    found = cut(parts.unionByName(copies).groupBy("doc_id").agg(F.collect_list("x").alias("found")))
    return _apply(docs.join(found, "doc_id", "left"), width, with_text)


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated windows cut out of the texts; a text of which no word is left goes with its row.

    ``n_chars``, if there, is counted anew for texts that changed.
    """
    got = dedup(documents, with_text=True).filter("n_removed = 0 or n_removed < n_words")
    columns = []
    for c in documents.columns:
        if c == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("rest.n_chars")).cast(documents.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("kept").alias("text") if c == "text" else F.col(c) if c == "doc_id" else F.col(f"rest.`{c}`").alias(c))
    return got.select(columns)

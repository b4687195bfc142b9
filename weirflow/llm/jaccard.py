"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of ``width``-word shingles.  Texts with the same words are one class; only its
smallest id is compared.  Banded MinHash proposes pairs (a pair at the threshold is missed with
probability below 1e-6).  Within a bucket, MinHash values are compared a few at a time; after m
agreements out of n, the posterior probability that the pair reaches the threshold is, under a
uniform prior, the chance of at most m successes in n + 1 draws at the threshold's rate; pairs for
which it falls below ``TOLERANCE`` are dropped.  Each pair that is left is verified once, exactly, on
the shingle sets, in the first bucket that its documents share (32-bit prints of the earlier bands
tell; by a collision of prints a pair is lost with probability below 1e-8).

Scale: a bucket of any size is cut into blocks, by documents and by shingles, that meet two at a
time, so no group is gathered in one task.  Of a pair of blocks go on: each document with a partner
left, once, with its partners' places among these documents (a list, or a bitmap if that is
shorter); from the verification: each document once, with its count of links and the smallest
document that it is connected with.  Sets are made and shipped only for documents with a partner
left.  Links inside a dense group of different texts are as many as the square of its size, and are
counted in as many pairs of blocks.

Defined results: a text of fewer than ``width`` words has one shingle, all of it; a null text or one
without words is in no class but its own and has no links; a row with a null id has null class and
group and no links.  Rows that repeat an id share its class, links and group, and are no links of each
other.  A similarity that equals the threshold is a link; of a class or group the smallest id names
it, so no ties are left.  Texts of any length are read whole; one very long set is a block of its own.
An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .words import Words, as_long, cut, mix, slices

WIDTH, THRESHOLD = 5, 0.8
#: Bands and rows of a band; values compared at a time; posterior below which a pair is dropped.
BANDS, ROWS, STEP, TOLERANCE = 35, 5, 25, 1e-6
#: Documents and shingles of a block at most (one document may have more shingles).
BLOCK, SHINGLES = 512, 1 << 20

_rng = np.random.Generator(np.random.PCG64(11))
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIXER = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their document indexes, in text order."""
    at = w.starts(width)
    s, d = w.windows(h, width, at), w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        s, d = np.concatenate([s, w.texts(h)[0][short]]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    return s, d


def minhashes(s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and their MinHash values (documents x BANDS*ROWS, 32 bits)."""
    if not len(s):
        return np.zeros(0, dtype=np.int64), np.zeros((0, BANDS * ROWS), dtype=np.uint32)
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((BANDS * ROWS, len(first)), dtype=np.uint32)
    for j in range(BANDS * ROWS):
        out[j] = np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], first)
    return d[first], out.T.copy()


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, total: int, step: int) -> tuple[int, ...]:
    """For n = step, 2 step, ... values: the fewest agreements that keep a pair.

    Values are compared by their lowest byte, which agrees by chance once in 256.
    """
    rate = threshold + (1 - threshold) / 256
    out = []
    for n in range(step, total + 1, step):
        tail, m = 0.0, -1
        while True:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(rate) + (n + 1 - m) * math.log1p(-rate))
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float = TOLERANCE, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the signature matrices a, b (low bytes) that are not dropped."""
    need = least_matches(threshold, tolerance, a.shape[1], step)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    same = np.zeros(len(i), dtype=np.int32)
    for k, m in enumerate(need):
        cols = slice(k * step, (k + 1) * step)
        same += (a[i, cols] == b[j, cols]).sum(axis=1, dtype=np.int32)
        keep = same >= m
        i, j, same = i[keep], j[keep], same[keep]
    return i, j


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id it is connected with) for the nodes of the pairs (indexes into ids) that are not smallest."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    a, b = place[i], place[j]
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[order[moved]], ids[order[label[moved]]]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """Tables of one key each, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def change(b: pa.RecordBatch) -> np.ndarray:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *change(b).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, key: str, fn: Callable[[pa.Table, pa.Table | None], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies ``fn(one block, another or None)`` to every pair of blocks of each key.

    ``rows`` has the key (bigint), ``blk`` and ``nb``: the row's block and the number of blocks.
    """
    n = F.col("nb")
    met = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), n - 1)))
    met = met.withColumn("_p", F.least("blk", "_x")).withColumn("_q", F.greatest("blk", "_x")).drop("_x")
    met = met.repartition(key, "_p", "_q").sortWithinPartitions(key, "_p", "_q", "blk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [key, "_p", "_q"]):
            p, q = t.column("_p")[0].as_py(), t.column("_q")[0].as_py()
            if p == q:
                out = fn(t, None)
            else:
                blk = t.column("blk").to_numpy()
                if (blk == blk[0]).all():
                    continue  # the other block has no rows, and pairs inside this one are compared elsewhere
                out = fn(t.filter(pa.array(blk == p)), t.filter(pa.array(blk == q)))
            if out is not None and out.num_rows:
                yield out

    return met.mapInArrow(run, schema)


def _bytes_matrix(t: pa.Table, name: str) -> np.ndarray:
    rows = t.column(name).to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)


def _first_of(ids: np.ndarray) -> np.ndarray:
    """Indexes of the first row of each id."""
    return np.unique(ids, return_index=True)[1]


def _distinct(t: pa.Table) -> pa.Table:
    """The rows without those that repeat a text and its id."""
    both = t.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ t.column("c1").to_numpy().view(np.uint64)
    at = _first_of(both)
    return t if len(at) == t.num_rows else t.take(pa.array(at))


def _partners(n: int, i: np.ndarray, j: np.ndarray) -> list[bytes]:
    """Of each of n places, its partners: 16-bit numbers, or a bitmap of n bits if that is shorter."""
    order = np.lexsort((j, i))
    i, j = i[order], j[order].astype("<u2")
    cuts = np.searchsorted(i, np.arange(n + 1))
    out, size = [], (n + 7) // 8
    for k in range(n):
        mine = j[cuts[k] : cuts[k + 1]]
        if len(mine) * 2 >= size:
            bits = np.zeros(size * 8, dtype=np.uint8)
            bits[mine] = 1
            out.append(b"b" + np.packbits(bits).tobytes())
        else:
            out.append(b"l" + mine.tobytes())
    return out


def partners(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``_partners`` wrote, as pairs of places."""
    i, j = [], []
    for k, raw in enumerate(rows):
        mine = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1))) if raw[:1] == b"b" else np.frombuffer(raw, "<u2", offset=1).astype(np.int64)
        i.append(np.full(len(mine), k))
        j.append(mine)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j])


def bucket_pairs(threshold: float, tolerance: float) -> Callable:
    """Documents of a block, or of two, with the partners that pruning leaves them and no earlier bucket has."""

    def fn(x: pa.Table, y: pa.Table | None) -> pa.RecordBatch | None:
        x, y = _distinct(x), None if y is None else _distinct(y)
        if y is None and x.num_rows < 2:
            return None
        sig = _bytes_matrix(x, "sig")
        i, j = surviving(sig, sig if y is None else _bytes_matrix(y, "sig"), threshold, tolerance)
        if y is None:
            keep = i < j
            i, j, both = i[keep], j[keep], x
        else:
            j, both = j + x.num_rows, pa.concat_tables([x, y])
        prints = both.column("prints").combine_chunks().flatten().to_numpy().reshape(both.num_rows, -1)
        ids = both.column("id").to_numpy()
        keep = ids[i] != ids[j]
        for lo in range(0, len(i), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            keep[part] &= ~(prints[i[part]] == prints[j[part]]).any(axis=1)
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        here = np.unique(np.concatenate([i, j]))
        some = both.take(pa.array(here))
        rows = _partners(len(here), np.searchsorted(here, i), np.searchsorted(here, j))
        columns = [some.column(c).combine_chunks() for c in ("key", "_p", "_q")]
        place = pa.array(np.arange(len(here), dtype=np.int32))
        return pa.RecordBatch.from_arrays([*columns, place, some.column("id").combine_chunks(), some.column("c1").combine_chunks(), pa.array(rows, pa.binary())], ["key", "_p", "_q", "place", "id", "c1", "with"])

    return fn


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sets."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, inverse = np.unique(flat, return_inverse=True)
    counts = np.bincount(inverse, minlength=len(names))
    shared = counts[inverse] > 1  # what only one set has is in no intersection
    of, inverse = of[shared], inverse[shared]
    if len(i) * 8 < len(sets) ** 2:
        # few pairs: mark the shingles of one side and count the marked ones of its partners
        cuts = np.searchsorted(of, np.arange(len(sets) + 1))
        order = np.argsort(i, kind="stable")
        out, marked = np.zeros(len(i), dtype=np.int64), np.zeros(len(names), dtype=bool)
        for run in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
            a = i[run[0]] if len(run) else 0
            mine = inverse[cuts[a] : cuts[a + 1]]
            marked[mine] = True
            for k in run:
                out[k] = np.count_nonzero(marked[inverse[cuts[j[k]] : cuts[j[k] + 1]]])
            marked[mine] = False
        return out
    names = np.unique(inverse)
    inverse = np.searchsorted(names, inverse)
    order = np.argsort(inverse, kind="stable")
    of, inverse = of[order], inverse[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for lo in range(0, len(names), 4096):
        a, b = np.searchsorted(inverse, (lo, lo + 4096))
        m = np.zeros((len(sets), min(4096, len(names) - lo)), dtype=np.float32)
        m[of[a:b], inverse[a:b] - lo] = 1
        total += (m @ m.T).astype(np.int64)
    return total[i, j]


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(key, _p, _q, place, id, with, sh) -> id, links, root: the pairs of each block pair that reach the threshold."""
    t = Fraction(threshold).limit_denominator(1000)
    met = rows.repartition("key", "_p", "_q").sortWithinPartitions("key", "_p", "_q", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["key", "_p", "_q"]):
            # rows that repeat an id and a text stand more than once
            g = g.take(pa.array(_first_of(g.column("place").to_numpy())))
            if g.num_rows != g.column("place")[-1].as_py() + 1:
                raise RuntimeError("a document's text has changed since its signature was made")
            ids, sets = g.column("id").to_numpy(), [np.frombuffer(x, np.uint64) for x in g.column("sh").to_pylist()]
            i, j = partners(g.column("with").to_pylist())
            both = intersections(sets, i, j)
            size = np.array([len(s) for s in sets])
            # inter / (joint - inter) >= t, in integers
            linked = both * (t.denominator + t.numerator) >= t.numerator * (size[i] + size[j])
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            root = dict(zip(*(x.tolist() for x in stars(ids, i, j)), strict=True))
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has].astype(np.int64)), pa.array([root.get(k, k) for k in ids[has].tolist()], pa.int64())], ["id", "links", "root"])

    return met.mapInArrow(run, "id bigint, links bigint, root bigint")


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            h = w.hashes()
            c1, c2 = w.texts(h)
            s, d = shingles(w, h, width)
            n = np.bincount(d, minlength=w.n_docs)
            d, m = minhashes(s, d)
            # a bucket's key ends in its band's number
            bands = np.empty((len(d), BANDS), dtype=np.uint64)
            for k in range(BANDS):
                key = mix((m[:, k * ROWS : (k + 1) * ROWS].astype(np.uint64) * _MIXER).sum(axis=1, dtype=np.uint64), k)
                bands[:, k] = key & ~np.uint64(63) | np.uint64(k)
            low = (m & np.uint32(255)).astype(np.uint8)
            ends = pa.array((np.arange(len(d) + 1) * BANDS).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(d)), as_long(c1[d]), as_long(c2[d]), pa.array(n[d]), pa.array([r.tobytes() for r in low], pa.binary()), pa.ListArray.from_arrays(ends, as_long(bands.ravel()))],
                ["doc_id", "c1", "c2", "size", "sig", "bands"],
            )

    return docs.mapInArrow(run, "doc_id bigint, c1 bigint, c2 bigint, size bigint, sig binary, bands array<bigint>")


def _members(reps: DataFrame, shared: DataFrame) -> DataFrame:
    """Each document under every bucket that it shares, with its signature and prints of its earlier bands."""
    each = reps.select("id", "c1", F.posexplode("bands").alias("band", "key")).join(shared, "key")
    prints = F.transform(F.slice("bands", F.lit(1), F.col("band")), lambda x: F.shiftright(x, 32).cast("int"))
    met = each.join(reps.select("id", "c1", "sig", "bands"), ["id", "c1"])
    return met.select("key", "nb", F.pmod(F.xxhash64("id", "c1"), F.col("nb")).cast("int").alias("blk"), "id", "c1", "sig", prints.alias("prints"))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, _p, _q, place, id, c1, with, text) -> the same with the set of shingle hashes, for rows whose text is the one meant."""
    passed = ["key", "_p", "_q", "place", "id", "with"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            # rows of a document stand together: its words are cut once
            ids, c1 = b.column("id").to_numpy(), b.column("c1").to_numpy()
            texts = b.column("text")
            new = np.ones(b.num_rows, dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (c1[1:] != c1[:-1]) | ~np.asarray(pa.compute.equal(texts.slice(1), texts.slice(0, b.num_rows - 1)))
            first = np.flatnonzero(new)
            w = Words(texts.take(pa.array(first)))
            h = w.hashes()
            s, d = shingles(w, h, width)
            cuts = np.searchsorted(d, np.arange(w.n_docs + 1))
            sets = [np.unique(s[cuts[k] : cuts[k + 1]]).tobytes() for k in range(w.n_docs)]
            of = np.cumsum(new) - 1
            meant = pa.array(w.texts(h)[0].view(np.int64)[of] == c1)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array([sets[k] for k in of], pa.binary())], [*passed, "sh"])
            yield out.filter(meant)

    return docs.mapInArrow(run, "key bigint, _p int, _q int, place int, id bigint, with binary, sh binary")


def left_pairs(reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The pairs that pruning leaves, as documents of block pairs: key, _p, _q, place, id, c1, with (see ``partners``)."""
    keys = reps.select("id", "c1", "size", F.explode("bands").alias("key"))
    # buckets with two texts or more; blocks by documents and by shingles
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("size") / SHINGLES))).cast("int")
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key", blocks.alias("nb")))
    return in_blocks(_members(reps, shared), "key", bucket_pairs(threshold, tolerance), "key bigint, _p int, _q int, place int, id bigint, c1 bigint, with binary")


def join(documents: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with the same words), n_links (other texts with
    Jaccard similarity of at least ``threshold``), group_id (smallest id reached through copies and links)."""
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    known = docs.filter("doc_id is not null and text is not null")
    s = cut(_signatures(known, width))
    owners = cut(s.groupBy("c1", "c2").agg(F.min("doc_id").alias("id")))
    reps = cut(s.withColumnRenamed("doc_id", "id").join(owners, ["c1", "c2", "id"]).select("id", "c1", "size", "sig", "bands"))
    left = cut(left_pairs(reps, threshold, tolerance))
    texts = known.withColumnRenamed("doc_id", "id").join(left, "id").select("key", "_p", "_q", "place", "id", "c1", "with", "text")
    found = cut(_verified(_sets(texts, width), threshold))
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = owners.join(links, "id", "left").join(groups, "id", "left")
    of_class = cut(of_class.select("c1", "c2", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("group_id")))
    got = s.select("doc_id", "c1", "c2").join(of_class, ["c1", "c2"]).select("doc_id", "class_id", "n_links", "group_id")
    rest = docs.filter(F.col("doc_id").isNull() | ~F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    return got.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("group_id")))


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, unchanged, without the near and exact copies of one with a smaller id.

    Of rows that repeat an id one stays; rows with a null id all stay.
    """
    d = join(documents, threshold).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("group_id")).alias("lost"), F.count("*").alias("n"))
    d = cut(d.filter("lost or n > 1"))
    lost, repeated = d.filter("lost").select("doc_id"), d.filter("not lost").select("doc_id")
    kept = documents.join(lost, "doc_id", "left_anti").select(documents.columns)
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").select(documents.columns).unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(documents.columns))

"""Media columns: local image descriptors find cropped or edited copies.

Corners (structure tensor, scales a quarter octave apart down to the smallest that holds a patch)
are all that are strongest in their neighbourhood, so their number grows with the image's area.
Each gets an orientation from its intensity centroid and a string of binary brightness tests on the
turned patch, so that brightness, contrast and turning change few of its bits.  Hash tables over
random choices of its bits propose matches; two images with matches at two corners are compared
whole: all close descriptors vote for a turn, scale and shift, and the pair is a copy if enough
distinct corners of both agree on one.

The tables find likely, not all, matches: two descriptors that differ in 4, 8 or 12 bits meet in a
table with probability 0.98, 0.76 and 0.41, so copies with few common corners may be missed.

Scale: byte-equal images are one class and only its smallest id is compared.  The tables are made one
after the other.  Buckets are cut into blocks that meet two at a time.

Defined results: an image that is null or cannot be read has no descriptors, its own class and no
links (null images are not copies of each other); a row with a null id has null class and group.
Rows that repeat an id share its result.  Images are binary PGM (P5, 8 bits).  Other columns than
media_id and image are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .words import cut

#: Ratio of scales; neighbourhood of a corner; patch radius, brightness tests; corners that must agree.
STEP, NEAR, RADIUS, TESTS, AGREE = 2**-0.25, 3, 12, 128, 5
#: Hash tables, bits of a key; bits that may differ in a bucket and between compared images; matches of a compared pair.
TABLES, KEY_BITS, BITS, WIDE, SEEN = 8, 28, 12, 18, 2
#: Turns that are told apart, descriptors of a block; pixels of a corner's scale and share of its distance that it may be off.
TURNS, BLOCK, OFF, OFF_SHARE = 64, 1024, 2.5, 0.02
_HEADER = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", re.S)

_rng = np.random.Generator(np.random.PCG64(23))
_r, _a = RADIUS * np.sqrt(_rng.uniform(0.05, 1, (TESTS, 2))), _rng.uniform(0, 2 * np.pi, (TESTS, 2))
#: dx, dy of both points of each test at each turn
_PATTERN = np.rint(np.stack([np.stack([_r * np.cos(_a + t), _r * np.sin(_a + t)], -1) for t in 2 * np.pi * np.arange(TURNS) / TURNS])).astype(int)
_dy, _dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISK = _dx**2 + _dy**2 <= RADIUS**2
_KEYS = np.stack([_rng.permutation(TESTS)[:KEY_BITS] for _ in range(TABLES)])


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def decode_pgm(raw: bytes | None) -> np.ndarray | None:
    m = _HEADER.match(raw or b"")
    if not m or int(m[3]) > 255:
        return None
    w, h = int(m[1]), int(m[2])
    body = raw[m.end() : m.end() + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w).astype(np.float32) if len(body) == w * h and w and h else None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1; edges are repeated."""
    p = np.pad(x, r + 1, mode="edge")[:-1, :-1]
    c = p.cumsum(0, dtype=np.float64).cumsum(1)
    n = 2 * r + 1
    h, w = x.shape
    return (c[n : n + h, n : n + w] - c[:h, n : n + w] - c[n : n + h, :w] + c[:h, :w]) / n**2


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = (max(1, int(s * scale)) for s in x.shape)
    smooth = _box(x, 1)
    yy, xx = np.minimum(np.arange(h) / scale, x.shape[0] - 1.001), np.minimum(np.arange(w) / scale, x.shape[1] - 1.001)
    y0, x0 = yy.astype(int), xx.astype(int)
    fy, fx = (yy - y0)[:, None], (xx - x0)[None]
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    return (smooth[np.ix_(y0, x0)] * (1 - fx) + smooth[np.ix_(y0, x1)] * fx) * (1 - fy) + (smooth[np.ix_(y1, x0)] * (1 - fx) + smooth[np.ix_(y1, x1)] * fx) * fy


def _most(x: np.ndarray, r: int) -> np.ndarray:
    """Largest value of squares of side 2r + 1."""
    for axis in (0, 1):
        p = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        n = x.shape[axis]
        x = np.maximum.reduce([p[k : k + n] if axis == 0 else p[:, k : k + n] for k in range(2 * r + 1)])
    return x


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale index, turn) in the image's pixels, and their descriptors (4 words of 32 bits)."""
    points, words = [], []
    edge = RADIUS + 2
    for level in range(64):
        scale = STEP**level
        if int(min(image.shape) * scale) <= 2 * edge + 2:
            break
        x = _resize(image, scale)
        s = _box(x, 1)
        gy, gx = np.gradient(s)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        core = r[edge:-edge, edge:-edge]
        peak = (core > 1e-6) & (core >= _most(r, NEAR)[edge:-edge, edge:-edge])
        y, z = np.nonzero(peak)
        if not len(y):
            continue
        y, z = y + edge, z + edge
        patch = s[y[:, None, None] + _dy, z[:, None, None] + _dx] * _DISK
        turn = np.rint(np.arctan2((patch * _dy).sum((1, 2)), (patch * _dx).sum((1, 2))) / (2 * np.pi) * TURNS).astype(int) % TURNS
        at = _PATTERN[turn]
        v = s[y[:, None, None] + at[..., 1], z[:, None, None] + at[..., 0]]
        bits = np.packbits(v[..., 0] < v[..., 1], axis=1)
        points.append(np.stack([z / scale, y / scale, np.full(len(y), level), turn], 1))
        words.append(bits.view(np.uint32))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, 4), dtype=np.uint32)
    return np.concatenate(points), np.concatenate(words)


def _describe_all(media: DataFrame) -> DataFrame:
    """id, p, d: corners (4 floats each) and descriptors (16 bytes each) of images that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                ids, points, words = [], [], []
                for i, raw in zip(part.column("id").to_pylist(), part.column("image").to_pylist(), strict=True):
                    image = decode_pgm(raw)
                    p, d = describe(image) if image is not None else ((), ())
                    if len(p):
                        ids.append(i)
                        points.append(p.astype(np.float32).tobytes())
                        words.append(d.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(points, pa.binary()), pa.array(words, pa.binary())], ["id", "p", "d"])

    return media.select("id", "image").mapInArrow(run, "id bigint, p binary, d binary")


def _keys(described: DataFrame, table: int) -> DataFrame:
    """key, id, k, d0, d1: each descriptor under its key in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = part.column("d").to_pylist()
                n = [len(x) // 16 for x in raw]
                d = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 16)
                bits = np.unpackbits(d, axis=1)[:, _KEYS[table]].astype(np.int64)
                two = np.ascontiguousarray(d).view(np.int64)
                k = np.concatenate([np.arange(m, dtype=np.int32) for m in n])
                yield pa.RecordBatch.from_arrays([pa.array(bits @ (1 << np.arange(KEY_BITS))), pa.array(np.repeat(part.column("id").to_numpy(), n)), pa.array(k), pa.array(two[:, 0]), pa.array(two[:, 1])], ["key", "id", "k", "d0", "d1"])

    return described.select("id", "d").mapInArrow(run, "key bigint, id bigint, k int, d0 bigint, d1 bigint")


def _bucket_pairs(t: pa.Table) -> pa.RecordBatch | None:
    """Close descriptors of different images in whole groups of (key, _p, _q), which lie together."""
    key, p, q, blk, ids, k, d0, d1 = (t.column(c).to_numpy() for c in ("key", "_p", "_q", "blk", "id", "k", "d0", "d1"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    end = np.repeat(start + size, size)
    out, at, shift = [], np.arange(len(key)), 1
    while True:
        at = at[at + shift < end[at]]
        if not len(at):
            break
        to = at + shift
        far = np.bitwise_count(d0[at] ^ d0[to]) + np.bitwise_count(d1[at] ^ d1[to])
        ok = (far <= BITS) & (ids[at] != ids[to]) & ((p[at] == q[at]) | (blk[at] != blk[to]))
        out.append((at[ok], to[ok]))
        shift += 1
    if not out:
        return None
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    swap = ids[i] > ids[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    got = np.unique(np.stack([ids[i], ids[j], k[i].astype(np.int64)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2].astype(np.int32))], ["a", "b", "k"])


def _in_table(described: DataFrame, table: int) -> DataFrame:
    """a, b, k: images that match in a table, and the corner of the first."""
    each = _keys(described, table)
    big = cut(each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")))
    rows = each.join(F.broadcast(big), "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("id", "k"), F.col("nb")).cast("int"))
    rows = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("_p", F.least("blk", "_x")).withColumn("_q", F.greatest("blk", "_x")).drop("_x", "nb")
    rows = rows.repartition("key", "_p", "_q").sortWithinPartitions("key", "_p", "_q", "blk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < 50_000:
                continue
            t = pa.Table.from_batches(held)
            key, p, q = (t.column(c).to_numpy() for c in ("key", "_p", "_q"))
            last = np.flatnonzero((key != key[-1]) | (p != p[-1]) | (q != q[-1]))
            upto = int(last[-1]) + 1 if len(last) else 0
            if upto and (got := _bucket_pairs(t.slice(0, upto))) is not None:
                yield got
            held = t.slice(upto).combine_chunks().to_batches()
            n = t.num_rows - upto
        if n and (got := _bucket_pairs(pa.Table.from_batches(held))) is not None:
            yield got

    return rows.mapInArrow(run, "a bigint, b bigint, k int").distinct()


def agreeing(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray, agree: int = AGREE) -> int:
    """Distinct corners of both images that agree on one motion; stops at ``agree``."""
    found = []
    for lo in range(0, len(da), 256):
        i, j = np.nonzero(np.bitwise_count(da[lo : lo + 256, None] ^ db[None]).sum(-1) <= WIDE)
        found.append((i + lo, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if min(len(np.unique(i)), len(np.unique(j))) < agree:
        return 0
    a, b = pa_[i, 0] + 1j * pa_[i, 1], pb[j, 0] + 1j * pb[j, 1]
    rough = STEP ** (pa_[i, 2] - pb[j, 2]) * np.exp(2j * np.pi * (pb[j, 3] - pa_[i, 3]) / TURNS)
    off = OFF / STEP ** pb[j, 2]
    best = 0
    for h in range(len(i)):
        x, y = a - a[h], b - b[h]
        alike = np.abs(rough / rough[h] - 1) < 0.45
        near = alike & (np.abs(y - rough[h] * x) <= off + 0.25 * np.abs(rough[h] * x))
        for _ in range(2):
            weight = (np.abs(x[near]) ** 2).sum()
            if not weight:
                break
            fit = (x[near].conj() * y[near]).sum() / weight
            near = alike & (np.abs(y - fit * x) <= off + OFF_SHARE * np.abs(fit * x))
        best = max(best, min(len(np.unique(i[near])), len(np.unique(j[near]))))
        if best >= agree:
            break
    return best


def _compared(both: DataFrame, agree: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("pa", "da", "pb", "db")), strict=True)
            votes = [agreeing(*(np.frombuffer(x, t).reshape(-1, m) for x, (t, m) in zip(row, ((np.float32, 4), (np.uint64, 2)) * 2, strict=True)), agree) for row in rows]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(votes, pa.int64())], ["a", "b", "votes"])

    return both.mapInArrow(run, "a bigint, b bigint, votes bigint")


def copies(media: DataFrame, agree: int = AGREE) -> DataFrame:
    """Pairs of different images that show the same: a, b (smallest ids of their classes), votes (counted up to ``agree``); and classes: id, h."""
    m = media.selectExpr("cast(media_id as bigint) id", "cast(image as binary) image").filter("id is not null and image is not null").withColumn("h", F.sha2("image", 256))
    classes = cut(m.select("id", "h"))
    owners = cut(classes.groupBy("h").agg(F.min("id").alias("id")))
    reps = m.join(owners, ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "image")
    described = cut(_describe_all(reps))
    matched = cut(_in_table(described, 0))
    for table in range(1, TABLES):
        matched = matched.unionByName(cut(_in_table(described, table)))
    likely = cut(matched.distinct().groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN).select("a", "b"))
    both = likely.join(described.select(F.col("id").alias("a"), F.col("p").alias("pa"), F.col("d").alias("da")), "a").join(described.select(F.col("id").alias("b"), F.col("p").alias("pb"), F.col("d").alias("db")), "b")
    pairs = _compared(both.select("a", "b", "pa", "da", "pb", "db"), agree).groupBy("a", "b").agg(F.max("votes").alias("votes")).filter(F.col("votes") >= agree)
    return cut(pairs), classes, owners


def groups(media: DataFrame, agree: int = AGREE) -> DataFrame:
    """One row per image: media_id, class_id, n_links (other images that are edited copies), group_id."""
    pairs, classes, owners = copies(media, agree)
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    found = owners.join(ends, "id", "left").join(components(pairs), "id", "left")
    of_class = cut(found.select("h", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("group_id")))
    got = classes.join(of_class, "h").select(F.col("id").alias("media_id"), "class_id", "n_links", "group_id")
    rest = media.selectExpr("cast(media_id as bigint) media_id", "cast(image as binary) image").filter("media_id is null or image is null")
    return got.unionByName(rest.select("media_id", F.col("media_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("media_id").alias("group_id")))


def render(vector: list[float] | None, side: int = 88) -> np.ndarray | None:
    """A textured picture of a vector: the same vector always gives the same picture."""
    if vector is None or any(x is None for x in vector):
        return None
    seed = crc32(np.array(vector, dtype=np.float32).tobytes()) << 32 | len(vector)
    cells = np.random.Generator(np.random.PCG64(seed)).uniform(0, 255, (side // 4, side // 4))
    return np.clip(_box(np.kron(cells, np.ones((4, 4))), 2), 0, 255).astype(np.uint8)


def edited(image: np.ndarray, left: int, top: int, contrast: float = 0.8, brightness: float = 18) -> np.ndarray:
    """A cropped copy with another contrast and brightness."""
    return np.clip(image[top:, left:] * contrast + brightness, 0, 255).astype(np.uint8)


def warped(image: np.ndarray, angle: float = 0, zoom: float = 1) -> np.ndarray:
    """A turned and resized copy; what the picture does not show repeats its edge."""
    h, w = image.shape
    x = _box(image.astype(np.float64), round(0.4 / zoom)) if zoom < 1 else image
    yy, xx = np.mgrid[: int(h * zoom), : int(w * zoom)] + 0.5
    dx, dy = xx / zoom - w / 2, yy / zoom - h / 2
    u = np.clip(np.cos(angle) * dx + np.sin(angle) * dy + w / 2 - 0.5, 0, w - 1.001)
    v = np.clip(np.cos(angle) * dy - np.sin(angle) * dx + h / 2 - 0.5, 0, h - 1.001)
    x0, y0 = u.astype(int), v.astype(int)
    fx, fy = u - x0, v - y0
    got = (x[y0, x0] * (1 - fx) + x[y0, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1, x0] * (1 - fx) + x[y0 + 1, x0 + 1] * fx) * fy
    return np.clip(got, 0, 255).astype(np.uint8)


#: Edits that the copies go through in turn.
EDITS = ("cropped", "turned", "resized", "noisy", "strongly cropped")


def planted(image: np.ndarray, i: int, every: int) -> np.ndarray:
    """The edited copy of row i's picture."""
    n = i // every
    kind = EDITS[n % len(EDITS)]
    if kind == "turned":
        return warped(image, 0.15 + n % 40 * 0.15)
    if kind == "resized":
        return warped(image, 0, (0.8, 0.9, 1.15, 1.3)[n // len(EDITS) % 4])
    if kind == "noisy":
        return np.clip(image + np.random.Generator(np.random.PCG64(abs(i))).normal(0, 8, image.shape), 0, 255).astype(np.uint8)
    if kind == "strongly cropped":
        h, w = image.shape
        return image[h // 5 : h // 5 + 2 * h // 3, w // 6 : w // 6 + 2 * w // 3]
    return edited(image, 4 + i % 11, 3 + i % 7)


def pictures(vectors: DataFrame, every: int = 50, of: int = 7) -> DataFrame:
    """media_id, image: a picture of each row, and an edited copy (id ``-1 - id``) of those with ``id mod every = of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                ids, images = [], []
                part = b.slice(lo, 64)
                for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True):
                    image = render(v)
                    ids.append(i)
                    images.append(None if image is None else encode_pgm(image))
                    if i is not None and image is not None and i % every == of:
                        ids.append(-1 - i)
                        images.append(encode_pgm(planted(image, i, every)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["media_id", "image"])

    return vectors.selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<float>) embedding").mapInArrow(run, "media_id bigint, image binary")

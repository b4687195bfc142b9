"""Operators 1 to 4 against brute force, with empty, null, long, tied and repeated input."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import edit_counts, jaccard, mixing, substring, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, c1 int, at int"


def docs(spark, rows):
    """(doc_id, text, source) rows, with columns whose names the operators also use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, "x", 1, 2) for i, t, s in rows], DOCS)


def vocabulary(n, seed=1):
    x = seed
    out = []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{(x >> 33) % 5000}")
    return out


# -- the word kernel


def test_words_are_bytes_between_white_space():
    import pyarrow as pa

    texts = ["a b", "", None, " \t x\n", "é ü z", "a b"]
    w = words.Words(pa.array(texts))
    assert w.count.tolist() == [2, 0, 0, 1, 2, 2]
    assert w.words_of(4) == ["é ü".encode(), b"z"]
    h = w.hashes()
    assert h[0] == h[5] and len(set(h.tolist())) == 5
    a, b = w.texts(h)
    assert a[0] == a[5] and b[0] == b[5] and a[1] == a[2] and len(set(a.tolist())) == 4


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    text = " ".join(vocabulary(3000))
    w = words.Words(pa.array(["x " + text, text]))
    h = w.hashes()
    at = w.starts(50)
    whole = w.windows(h, 50, at)
    monkeypatch.setattr(words, "BLOCK", 64)
    assert (w.hashes() == h).all() and (w.windows(h, 50, at) == whole).all()
    n = 3000 - 49
    assert (whole[1 : 1 + n] == whole[-n:]).all()


def test_slices_keep_every_row():
    import pyarrow as pa

    b = pa.record_batch({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    parts = list(words.slices(iter([b]), "text", most=20))
    assert pa.Table.from_batches(parts).to_pydict() == b.to_pydict() and len(parts) >= 3


# -- 1


def brute_substring(rows, width):
    first = {}
    for i, t, _ in rows:
        if i is None or t is None:
            continue
        w = t.split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, _ in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def substring_rows():
    v = vocabulary(4000)
    shared = v[:120]
    rows = [
        (5, " ".join(v[200:400]), "a"), (2, " ".join(v[400:500] + shared + v[500:560]), "a"), (9, " ".join(shared[10:80] + v[600:650] + shared[30:]), "b"), (1, " ".join(v[700:710]), None), (3, None, "a"), (4, "", "b"),
        (7, " ".join(v[200:400]), "c"), (8, " ".join(v[200:300] + ["edit"] + v[300:400]), "c"), (None, " ".join(v[200:400]), "c"), (10, "same " * 300, "a"), (11, "same " * 90, "a"), (12, " ".join(v[1000:3900]) + " é", "b"),
        (13, " ".join(v[1500:1549]), "b"), (14, " ".join(v[1500:1550]), "b"), (15, "\n".join(v[1490:1560]), "b"), (5, " ".join(v[200:400]), "a"),
    ]
    return rows


def test_substring_dedup(spark):
    rows = substring_rows()
    got = substring.dedup(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_substring(rows, 50)))


def test_substring_small_windows(spark):
    v = ["a", "b", "c"]
    rows = [(i, " ".join(v[(i * k * k) % 3] for k in range(40)), "s") for i in range(12)]
    got = substring.dedup(docs(spark, rows), width=9, period=7, cover=(0, 1, 3)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_substring(rows, 9))


def test_substring_empty_table_and_covers(spark):
    assert substring.dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="cover"):
        substring.check_cover(7, (0, 1, 2))
    substring.check_cover(substring.PERIOD, substring.COVER)


def test_without_repeats_keeps_columns(spark):
    rows = substring_rows()
    d = docs(spark, rows)
    got = substring.without_repeats(d)
    assert got.columns == d.columns
    by = {r.doc_id: r for r in got.collect()}
    assert 7 not in by and by[12].text == rows[11][1] and by[9].n_chars == len(by[9].text) and by[None].text == rows[8][1]


# -- 2


def capped(sizes, weights, most):
    total, cap = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in cap)
        w = sum(weights[i] for i in range(len(sizes)) if i not in cap)
        t = [most * s if i in cap else left * weights[i] / w if w else 0 for i, s in enumerate(sizes)]
        new = {i for i, s in enumerate(sizes) if i not in cap and t[i] > most * s + 1e-9}
        if not new:
            return t
        cap |= new


@pytest.mark.parametrize("sizes", [[100, 5, 900, 30], [1, 1, 1000], [50, 50, 50], [10], [0, 7, 7, 400]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", v) for k, v in enumerate(sizes)], "source string, source_size bigint")
    got = [r.target for r in mixing.targets(df, (1.0, 2.0, 3.0), 3).orderBy("source").collect()]
    assert got == pytest.approx(capped(sizes, [1 + k % 3 for k in range(len(sizes))], 3))
    assert sum(got) == pytest.approx(sum(sizes))


def test_fit_is_exact_where_it_can_be():
    assert (mixing.fit([7, 5], [10, 10], 24) * [7, 5]).sum() == 24
    assert (mixing.fit([10], [5], 25) * [10]).sum() == 20
    assert mixing.fit([3, 4], [2, 2], 99).tolist() == [2, 2] and mixing.fit([3], [2], 0).tolist() == [0]
    lengths = list(range(1, 200))
    take = mixing.fit(lengths, [3] * 199, 12_345)
    assert (take * lengths).sum() == 12_345 and take.max() <= 3
    take = mixing.fit([999, 1001, 64], [1000, 1000, 1000], 1_000_003, reserve=5000)
    assert 0 <= 1_000_003 - (take * [999, 1001, 64]).sum() < 64


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), ["a", "b", None, "é"][i % 4]) for i in range(400)] + [(999, None, "a"), (None, "one two", "b"), (3, "one two three", "a"), (3, "one two three", "a")]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mix(d.repartition(3)).collect() if r.doc_id not in (3, None)}
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.doc_id in (3, None) or again[r.doc_id, r.source, r.size] == r.taken
    order = ["a", "b", "é", None]
    assert [by[s][0] for s in order] == [by[s][3] for s in order]
    assert [by[s][2] for s in order] == pytest.approx(capped([by[s][0] for s in order], [1, 2, 3, 1], 3))
    # the lengths of one source are multiples of four
    assert all(abs(s[1] - s[2]) < 4 for s in by.values())
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixed_rows(spark):
    rows = [(i, " ".join(["w"] * (5 + i)), "ab"[i % 2]) for i in range(30)]
    d = docs(spark, rows)
    want = {r.doc_id: r.copies for r in mixing.mix(d).collect() if r.copies}
    got = Counter(r.doc_id for r in mixing.mixed(d).collect())
    assert got == want and mixing.mixed(d).columns == d.columns


def test_mixed_takes_rows_without_id_and_repeated_rows_as_planned(spark):
    rows = [(None if i % 3 else i % 4, " ".join(["w"] * (3 + i % 50)) + f" {i // 2}", "abc"[i % 3]) for i in range(300)] + [(None, None, "a"), (None, "w " * 150_000, "b")]
    d = docs(spark, rows).withColumnsRenamed({"h": "_copies", "c1": "_copy", "at": "row", "lang": "copies"})
    want = Counter()
    for r in mixing.mix(d).collect():
        want[r.source] += r.taken
    got = Counter()
    for r in mixing.mixed(d).collect():
        got[r.source] += len((r.text or "").split())
    assert got == want and mixing.mixed(d).columns == d.columns
    assert mixing.mixed(docs(spark, [])).count() == 0


# -- 3


def brute_jaccard(rows, t=0.8, width=5):
    owner, sets = {}, {}
    for i, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = tuple((text or "").split())
        if w:
            if w not in owner:
                owner[w] = i
                sets[i] = frozenset(w[k : k + width] for k in range(len(w) - width + 1)) or frozenset([w])
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    out = []
    for i, text, _ in rows:
        w = tuple((text or "").split())
        o = owner[w] if w and i is not None else i
        out.append((i, o, links[o] if w else 0, find(o) if w and i is not None else i))
    return out


def near_rows():
    v = vocabulary(6000, 5)
    rows = [(100 + k, " ".join(v[150 * k : 150 * k + 150]), "a") for k in range(12)]
    base = v[3000:3200]
    for k in range(40):  # a dense group: copies with one to three edits each
        w = list(base)
        for e in range(1 + k % 3):
            w[(17 * k + 61 * e) % 200] = f"edit{k}"
        rows.append((200 + k, " ".join(w), "b"))
    rows += [(50, " ".join(base), "b"), (51, "  ".join(base), "b"), (60, "one two", "c"), (61, "one  two", "c"), (62, "one two three", "c"), (63, "", "c"), (64, None, "c"), (None, "one two", "c"), (65, "", "c"), (100, rows[0][1], "a")]
    return rows


def test_jaccard_join(spark):
    rows = near_rows()
    got = jaccard.join(docs(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_jaccard(rows)))


def test_jaccard_blocks_meet_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rows = near_rows()
    got = jaccard.join(docs(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_jaccard(rows)))


def test_one_of_each(spark):
    d = docs(spark, near_rows())
    got = jaccard.one_of_each(d)
    ids = [r.doc_id for r in got.collect()]
    want = {g for i, _, _, g in brute_jaccard(near_rows()) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1 and got.columns == d.columns
    assert jaccard.join(docs(spark, [])).count() == 0


def chain(n, length=60, step=8):
    """Texts of which each overlaps the next ones: one component, and only neighbours are alike."""
    v = vocabulary(n * step + length, 9)
    return [(k, " ".join(v[k * step : k * step + length]), "a") for k in range(n)]


def test_only_pairs_that_pruning_leaves_are_verified(spark):
    rows = chain(5000, step=4) + near_rows()[12:52]
    table = pa.table({"doc_id": [r[0] + 100_000 * (r[2] == "b") for r in rows], "text": [r[1] for r in rows]})
    d = spark.createDataFrame(table.to_pandas()).repartition(7)
    s = jaccard._signatures(d, 5).collect()
    sig = np.stack([np.frombuffer(r.sig, np.uint8) for r in s])
    shared = {}
    for k, r in enumerate(s):
        for key in r.bands:
            shared.setdefault(key, []).append(k)
    met = np.array(sorted({(a, b) for x in shared.values() for a in x for b in x if a < b}))
    need = jaccard.least_matches(0.8, 1e-6, 175, 25)
    same = np.cumsum(sig[met[:, 0]] == sig[met[:, 1]], axis=1)[:, 24::25]
    left = met[(same >= np.array(need)).all(axis=1)]
    want = sorted(tuple(sorted((s[a].doc_id, s[b].doc_id))) for a, b in left.tolist())
    reps = spark.createDataFrame(s).withColumnRenamed("doc_id", "id").select("id", "c1", "size", "sig", "bands")
    blocks = {}
    for r in jaccard.left_pairs(reps).collect():
        blocks.setdefault((r["key"], r["_p"], r["_q"]), []).append((r["place"], r["id"], r["with"]))
    got, shipped = [], 0
    for x in blocks.values():
        x.sort()
        assert [p for p, *_ in x] == list(range(len(x)))
        shipped += len(x)
        i, j = jaccard.partners([bytes(w) for *_, w in x])
        got += [tuple(sorted((x[a][1], x[b][1]))) for a, b in zip(i.tolist(), j.tolist())]
    assert len(want) > 4000 and sorted(got) == want  # each once
    assert shipped <= 2 * len(want)  # sets go where they have a partner, not to all of their component
    links = {r.doc_id: r.n_links for r in jaccard.join(d.filter("doc_id < 300")).collect()}
    true = Counter()
    for k in range(300):
        for m in range(k + 1, min(k + 4, 300)):
            a, b = (set(zip(*(rows[x][1].split()[e:] for e in range(5)))) for x in (k, m))
            if 5 * len(a & b) >= 4 * len(a | b):
                true[k] += 1
                true[m] += 1
    assert links == {k: true[k] for k in range(300)}


@pytest.mark.parametrize("n", [1, 7, 64, 700])
def test_partner_lists_come_back(n):
    rng = np.random.Generator(np.random.PCG64(n))
    for share in (0, 0.01, 0.3, 1):
        i, j = np.nonzero(np.triu(rng.uniform(size=(n, n)) < share, 1))
        a, b = jaccard.partners(jaccard._partners(n, i, j))
        assert list(zip(a.tolist(), b.tolist())) == list(zip(i.tolist(), j.tolist()))


def test_intersections_by_marks_and_by_products():
    rng = np.random.Generator(np.random.PCG64(2))
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert jaccard.intersections(sets, i, j).tolist() == want
    some = np.array([400, 3, 77, 3, 200])
    assert jaccard.intersections(sets, i[some], j[some]).tolist() == [want[k] for k in some]


def test_join_of_very_long_texts_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHINGLES", 50_000)
    long = " ".join(vocabulary(120_000, 4))
    rows = [(5, long, "a"), (6, long + " more", "a"), (7, long, "b"), (8, "x " + long, "a"), (9, "some other words", "a"), (9, long + " again", "a"), (None, long, "a"), (None, long, "a"), (None, None, None)]
    got = {(r.doc_id, r.class_id, r.n_links, r.group_id) for r in jaccard.join(docs(spark, rows)).collect() if r.doc_id != 9}
    assert got == {(5, 5, 3, 5), (6, 6, 3, 5), (7, 5, 3, 5), (8, 8, 3, 5), (None, None, 0, None)}


def test_pruning_keeps_pairs_at_the_threshold():
    need = jaccard.least_matches(0.8, 1e-6, 175, 25)
    assert list(need) == sorted(need) and need[-1] < 175 * 0.8
    for n, m in zip(range(25, 176, 25), need, strict=True):
        rate = 0.8 + 0.2 / 256
        chance = sum(math.comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(m))
        assert chance < 1e-4  # a pair at the threshold is seldom dropped
    miss = (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS
    assert miss < 1e-6


def test_components(spark):
    from weirflow.llm.graph import components

    path = [(k, k + 1) for k in range(30)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 4


@pytest.fixture(scope="module")
def counter():
    P = pytest.importorskip("public_tokenizers")
    return edit_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_trees_follow_edits(counter):
    import random

    r = random.Random(4)
    for text in ("", "   ", "a  b", " ".join(vocabulary(400)), "don't stop 12 345  \n\n x" * 30):
        tree = edit_counts.TokenTree(text, counter)
        for _ in range(25):
            tree.edit(r.randrange(-2, len(tree.text) + 3), r.choice([0, 1, 4, 60]), r.choice(["", " ", "'ll", "  x", "\n", "<email>", "many words in a row " * 12]))
            assert tree.total == len(counter.encoding.encode_ordinary(tree.text)) and tree._root.chars == len(tree.text)


def test_small_edits_encode_little_again(counter):
    tree = edit_counts.TokenTree(" ".join(vocabulary(5000)), counter)
    tree.edit(9000, 3, "xyz")
    assert tree.reencoded < 12


def plain(counter, text, edits):
    for start, length, put in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + put + text[start + max(length, 0) :]
    return text, sum(counter.split(text)[1])


def depth(node):
    return 0 if node.left is None else 1 + max(depth(node.left), depth(node.right))


@settings(max_examples=150, deadline=None)
@given(st.text("ab1 \n'st.é", max_size=200), st.lists(st.tuples(st.integers(-3, 220), st.integers(-1, 60), st.text("ab1 \n's.é", max_size=30)), max_size=25))
def test_edits_against_encoding_anew(text, edits):
    how = edit_counts.counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    before = edit_counts.LEAF
    try:
        edit_counts.LEAF = 2
        tree = edit_counts.TokenTree(text, how)
        for e in edits:
            tree.edit(*e)
        assert (tree.text, tree.total) == plain(how, text, edits)
    finally:
        edit_counts.LEAF = before


def test_edits_of_a_long_text_read_what_is_near(counter):
    text = "some words and 12 more, " * 42_000  # a million characters
    tree = edit_counts.TokenTree(text, counter)
    edits = [(k, 2, "xy z") for k in range(len(text) - 7, 0, -700)] + [(500_000, 0, "grow ")] * 3000 + [(10, 400_000, "")] + [(3 * k, 1, "") for k in range(500)]
    for e in edits:
        tree.edit(*e)
    assert (tree.text, tree.total) == plain(counter, text, edits)
    assert tree.read < 1000 * len(edits) + 2 * len(text) and depth(tree._root) < 40


def test_counts_of_documents(spark, counter):
    P = pytest.importorskip("public_tokenizers")
    rows = [(1, "mail a.b@c.org now, or 10.0.0.1!", "s"), (2, None, "s"), (3, "", "s"), (None, "plain", "s"), (1, "mail a.b@c.org now, or 10.0.0.1!", "s")]
    got = edit_counts.count_edited(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    n = lambda t: len(counter.encoding.encode_ordinary(t))
    want = (1, n(rows[0][1]), 2, n("mail <email> now, or <ip>!"))
    assert [tuple(r)[:4] for r in got if r.doc_id == 1] == [want, want]
    assert {(r.doc_id, r.n_tokens, r.n_edits) for r in got if r.doc_id != 1} == {(2, 0, 0), (3, 0, 0), (None, 1, 0)}
    d = docs(spark, rows).withColumn("edits", F.expr("array(named_struct('start', 0, 'length', 4, 'put', 'post'))"))
    by = edit_counts.count_edited(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, edits="edits").filter("doc_id = 1").first()
    assert by.n_edits == 1 and by.n_tokens_edited == n("post" + rows[0][1][4:])


# -- the pipeline


def test_pipeline_rows_equal_a_plain_chain(spark, tmp_path):
    """run() against the stages in plain Python, given the classifier's scores and which rows of a length the mix's hash takes."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp
    import numpy as np
    from tokenizers import Tokenizer

    from weirflow.llm import quality, queries

    v = vocabulary(9000, 8)
    rows = [(i, " ".join(v[90 * i : 90 * i + 60 + i % 4 * 10]).capitalize() + ".", "abc"[i % 3]) for i in range(40)]
    rows += [(100 + k, rows[k][1].replace(" w", "  w", 3), "c") for k in range(4)]  # exact copies but for blanks
    rows += [(110 + k, rows[5 + k][1] + " edit", "b") for k in range(4)]  # near copies
    rows += [(120 + k, " ".join(v[5000 + 90 * k : 5070 + 90 * k]) + " " + rows[12 + k][1] + " " + " ".join(v[6000 + 90 * k : 6050 + 90 * k]), "a") for k in range(6)]  # repeated passages
    rows += [(200 + k, " | ".join(x.upper() + "!!" for x in v[7000 + 40 * k : 7040 + 40 * k]), "b") for k in range(20)]  # junk
    labels = [(i, int(i < 200), 0) for i, _, _ in rows]
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    folder = f"file://{tmp_path}"
    d.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    lab.write.parquet(f"{folder}/labels.parquet")

    good = {r.doc_id for r in quality.score(d, lab).collect() if r.score >= 0.5}
    left = [r for r in rows if r[0] in good]
    assert 0 < len(left) < len(rows)
    first = {i for i, _, _, g in brute_jaccard(left) if i == g}
    assert len(first) < len(left)
    left = [r for r in left if r[0] in first]
    gone = {i: n for i, _, n, _ in brute_substring(left, 50)}
    assert any(gone.values())
    kept, seen = [], {}
    for i, text, source in sorted(left):
        w, out = text.split(), set()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                out.update(range(k, k + 50))
        assert len(out) == gone[i]
        if len(out) < len(w):
            kept.append((i, " ".join(x for k, x in enumerate(w) if k not in out) if out else text, source))

    lib = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    digest = {i: hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t, _ in kept}
    got = cp.run(spark, folder).collect()
    assert {(r.doc_id, r.ids_sha256) for r in got} <= set(digest.items())
    copies = Counter(r.doc_id for r in got)
    by = {s: [(i, len(t.split())) for i, t, x in kept if x == s] for s in sorted({x for _, _, x in kept})}
    sizes = [sum(n for _, n in x) for x in by.values()]
    for members, size, target in zip(by.values(), sizes, capped(sizes, [1 + k % 3 for k in range(len(sizes))], 3), strict=True):
        times = min(3, int(target // size))
        lengths = sorted(Counter(n for _, n in members).items())
        extra = mixing.fit([n for n, _ in lengths], [c for _, c in lengths], int(round(target - times * size)) if times < 3 else 0)
        for (n, c), more in zip(lengths, extra, strict=True):
            assert sorted(copies[i] for i, m in members if m == n) == [times] * (c - more) + [times + 1] * more

"""Operators 5 to 10 and the pipeline against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest


from weirflow.llm import html_blocks, langid, media, prefix_bpe, quality, queries, topk

DOCS = "doc_id bigint, text string, lang string, source string, f int, k int, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "x") for i, t, lang in rows], DOCS)


# -- 5


def languages(n=240, seed=3):
    r = random.Random(seed)
    letters = {"aa": "abcdeflmn", "bb": "opqrstuvw", "cc": "éèàùaeiouy"}
    rows = []
    for i in range(n):
        lang = r.choice(list(letters))
        rows.append((i, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(3, 8))) for _ in range(r.randint(4, 60))), lang))
    return rows


def test_language_held_out_accuracy(spark):
    rows = languages()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (None, rows[0][1], "aa"), (1003, rows[1][1], None), (5, rows[5][1], rows[5][2]), (1004, "abc de " * 30_000, "aa")]
    got = langid.identify(docs(spark, rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if by[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    for i, _, _ in rows:
        assert by[i].held_out == (crc32(str(i).encode()) % 4 == 2)
        assert by[i].lang_pred in ("aa", "bb", "cc") and 0 <= by[i].score <= 1
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1004].lang_pred == "aa" and not by[None].held_out


def test_language_never_reads_labels_of_predictions(spark):
    rows = languages(120)
    one = {r.doc_id: tuple(r) for r in langid.identify(docs(spark, rows)).collect()}
    other = [(i, t, "zz" if crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    two = {r.doc_id: tuple(r) for r in langid.identify(docs(spark, other)).collect()}
    assert {k: v[:3] for k, v in one.items()} == {k: v[:3] for k, v in two.items()}


def test_language_without_labels(spark):
    assert [r.lang_pred for r in langid.identify(docs(spark, [(1, "hello", None)])).collect()] == ["und"]
    assert langid.identify(docs(spark, [])).count() == 0


def test_grams_do_not_depend_on_spans(monkeypatch):
    text = "Größe, naïve été! " * 50
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "SPAN", 37)
    assert (np.sort(np.concatenate(list(langid.grams(text)))) == whole).all()


def test_weights_are_sparse_and_calibrated():
    idf = np.ones(1 << langid.BITS)
    rows = [(*langid.vector(t, idf), "aa bb cc".split().index(lang)) for _, t, lang in languages(150)]
    m = langid.Model(["aa", "bb", "cc"], idf)
    m.train(rows)
    used = np.unique(np.concatenate([a for a, *_ in rows]))
    assert (m.weights()[np.setdiff1d(np.arange(1 << langid.BITS), used)] == 0).all()
    assert (m.weights(used) == 0).mean() > 0.05
    m.finish(rows)
    assert 0.05 <= m.temperature <= 20.01


# -- 6


def test_search_against_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = [(int(i), r.integers(-3, 4, 6) / 4 if i % 5 else r.normal(size=6)) for i in r.permutation(500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    rows += [(600, None), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (None, [1.0] * 6), (1000, [0.5, 0.25]), (1001, [0.5, 0.5]), (1100, []), rows[0]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, n int, block string")
    got = {}
    for x in topk.search(df).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    ok = [(i, np.floor(1024 * np.float64(np.float32(v))).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for at, (q, v) in enumerate(ok):
        if q % 100 == 0 and q != rows[0][0]:
            others = sorted((-int(v @ w), c) for k, (c, w) in enumerate(ok) if k != at and len(w) == len(v))[:10]
            assert sorted(got[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(others)], q
    assert not {600, 700, 800, 900, 1100} & set(got)


def test_search_small_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float((i * 7) % 5), float(i % 3)]) for i in range(900)], "vec_id bigint, embedding array<float>")
    want = sorted(map(tuple, topk.search(df).collect()))
    for name, value in (("BLOCK", 37), ("QUERIES", 2), ("BLOCKS_A_TASK", 3)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.search(df).collect())) == want and len(want) == 90
    assert topk.search(df.limit(0)).count() == 0


def test_accumulate_and_best():
    r = np.random.default_rng(0)
    q, c = r.integers(-5, 6, (7, 9)) * r.integers(0, 2, (7, 9)), r.integers(-5, 6, (40, 9)) * r.integers(0, 2, (40, 9))
    assert (topk.accumulate(q, c) == q @ c.T).all()
    big = topk.accumulate(q * (1 << 20), c * (1 << 20))
    assert big.dtype == np.int64 and (big == (q @ c.T) << 40).all()
    s = np.array([[3, 5, 5, 5, 1]])
    assert sorted(topk.best(s, 2)[0]) == [1, 2]


# -- 7


def test_edited_copies_are_found(spark):
    r = np.random.default_rng(5)
    images = [media.render(r.normal(size=16).tolist()) for _ in range(12)]
    rows = [(k, media.encode_pgm(x)) for k, x in enumerate(images)]
    rows += [(100 + k, media.encode_pgm(media.edited(images[k], 5 + k, 4 + 2 * k))) for k in range(4)]
    rows += [(200, rows[0][1]), (201, rows[11][1]), (300, None), (301, b"no image"), (302, media.encode_pgm(np.zeros((40, 40)))), (None, rows[3][1]), (303, media.encode_pgm(np.full((3, 3), 9)))]
    df = spark.createDataFrame([(i, x, 1, 2.0) for i, x in rows], "media_id bigint, image binary, k int, x double")
    got = {r.media_id: r for r in media.groups(df).collect()}
    assert len(got) == len(rows)
    for k in range(4):
        assert got[100 + k].group_id == got[k].group_id == k and got[k].n_links >= 1
    assert got[200].class_id == 0 and got[201].class_id == 11
    assert all(got[k].group_id == k and got[k].n_links == 0 for k in (*range(4, 12), 300, 301, 302, 303)) and got[None].class_id is None
    assert media.groups(df.limit(0)).count() == 0


def test_turned_resized_noisy_and_strongly_cropped_copies_are_found(spark):
    r = np.random.default_rng(8)
    images = [media.render(r.normal(size=16).tolist()) for _ in range(10)]
    rows = list(enumerate(images)) + [(100 + k, media.planted(x, k, 1)) for k, x in enumerate(images)]
    large = media.render(list(range(16)), 400)
    rows += [(50, large), (150, large[210:310, 60:160]), (151, media.warped(large, 0.7, 0.65)), (152, np.rot90(large))]
    df = spark.createDataFrame([(i, media.encode_pgm(x)) for i, x in rows], "media_id bigint, image binary")
    got = {x.media_id: x.group_id for x in media.groups(df).collect()}
    assert sum(got[100 + k] == k for k in range(10)) >= 9 and all(got[k] == k for k in range(10))
    assert got[50] == got[150] == got[151] == got[152]


def test_corners_grow_with_the_area():
    small, large = (len(media.describe(media.render(list(range(16)), side).astype(np.float32))[0]) for side in (100, 400))
    assert large > 12 * small > 0


def test_buckets_in_blocks_give_all_pairs():
    import pyarrow as pa

    r = np.random.default_rng(4)
    n, blocks = 40, 3
    d, blk = r.integers(0, 4, n), r.integers(0, blocks, n)
    rows = sorted((7, min(blk[i], x), max(blk[i], x), blk[i], i % 30, i, int(d[i]) << 50, 0) for i in range(n) for x in range(blocks))
    got = media._bucket_pairs(pa.table({c: [row[k] for row in rows] for k, c in enumerate(("key", "_p", "_q", "blk", "id", "k", "d0", "d1"))}))
    pairs = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert pairs == {(a % 30, b % 30) for a in range(n) for b in range(n) if a % 30 < b % 30}


def test_descriptors_ignore_brightness_and_turns():
    image = media.render(list(range(16))).astype(np.float32)
    p, d = media.describe(image)
    assert len(p) > 10
    same = {tuple(x) for x in d.tolist()}
    _, e = media.describe(0.5 * image + 30)
    assert sum(tuple(x) in same for x in e.tolist()) > 0.8 * len(e)
    _, t = media.describe(np.rot90(image).copy())
    far = np.bitwise_count(t[:, None] ^ d[None]).sum(-1).min(1)
    assert (far <= 20).mean() > 0.3
    assert media.decode_pgm(b"P5 # c\n2 1\n255\n\x01\x02").tolist() == [[1, 2]] and media.decode_pgm(b"P5\n2 2\n255\n\x01") is None


# -- 8


@pytest.fixture(scope="module")
def pair():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    return prefix_bpe.tokenizer(path), Tokenizer.from_file(path)


def texts():
    r = random.Random(9)
    yield from ("", " \t\n", "don't we'll I'M THEY'RE 12345 ²½ Ⅷ", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ẞ ﬁ Å é ñ", "日本語テキスト 😀👍🏽", "!\x1c! a\x1db\x85c\xa0d​e", "<|endoftext|>hi<|startoftext|> <|ENDOFTEXT|> x<|endoftext|>", "a" * 3000, "_a_ b__c", "x\x00y")
    for _ in range(150):
        yield "".join(r.choice("abcdehinorst' ") for _ in range(200))
        yield "".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x300, 0x530), r.randrange(0x4E00, 0x4F00)])) for _ in range(80))


def test_bpe_equals_the_library(pair):
    mine, lib = pair
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t).tolist() == ids, t
        assert mine.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_on_a_toy_vocabulary():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa", "aaa"])}
    bpe = prefix_bpe.PrefixBPE(vocab, [("a", "a"), ("b", "c"), ("a", "b"), ("a", "bc"), ("aa", "a")])

    def plain(s):
        parts = list(s)
        while True:
            ranks = [(bpe.rank.get((parts[i], parts[i + 1]), 99), i) for i in range(len(parts) - 1)]
            if not ranks or min(ranks)[0] == 99:
                return [vocab[p] for p in parts]
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        assert bpe.encode_word(s) == plain(s), s


def test_bpe_of_documents(spark, pair, monkeypatch):
    _, lib = pair
    rows = [(k, t, "en") for k, t in enumerate(texts()) if k < 40] + [(900, None, "en"), (None, "Hello", None), (3, "again", "en")]
    got = prefix_bpe.encode_documents(docs(spark, rows), queries.tokenizer_file("word_bpe_49k.json"), with_ids=True).collect()
    for r, (i, t, _) in zip(got, rows, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, said)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_bpe_tables_start_anew(pair, monkeypatch):
    mine, lib = pair
    monkeypatch.setattr(prefix_bpe, "KEEP", 5)
    t = " ".join(f"w{k} x{k}y" for k in range(200))
    assert mine.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


# -- 9


def quality_rows(n=500):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(20, 200))]
        good = i % 3 != 0
        text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) if good else " | ".join(words) if i % 2 else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_held_out_accuracy(spark):
    rows, labels = quality_rows()
    extra = [(5000, None, "en"), (5001, "", None), (None, rows[1][1], "en"), (1, rows[1][1], "en"), (5002, "word " * 200_000, "en")]
    lab = spark.createDataFrame([*labels, (1, 1, 0), (2, None, None), (None, 1, 0), (99999, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs(spark, rows + extra), lab).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, q) for i, q, _ in labels if by[i].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1)
    assert by[5000].score == by[5001].score


def test_quality_without_labels(spark):
    rows, _ = quality_rows(6)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.score(docs(spark, rows), none).collect()} == {0.5}
    assert quality.score(docs(spark, []), none).count() == 0


def test_keep_good(spark):
    rows, labels = quality_rows(200)
    d = docs(spark, rows)
    kept = quality.keep_good(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    good = {i for i, q, _ in labels if q}
    assert len(good - ids) <= 4 and len(ids - good) <= 4
    # columns named like the one that is added pass through; null and empty texts and an empty table do not fail
    clash = d.selectExpr("*", "cast(doc_id as string) _STATS")
    clash = clash.union(spark.createDataFrame([(None,) * len(clash.columns), (None, "", *(None,) * (len(clash.columns) - 2))], clash.schema))
    again = quality.keep_good(clash, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert again.columns == clash.columns
    assert {r.doc_id for r in again.filter("_STATS = cast(doc_id as string)").collect()} == ids
    assert quality.keep_good(d.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_pool():
    assert quality.pool(np.array([1.0, 0.0, 2.0, 1.0, 3.0]), np.ones(5)).tolist() == [0.5, 0.5, 1.5, 1.5, 3.0]
    assert quality.pool(np.array([3.0, 0.0]), np.array([1.0, 2.0])).tolist() == [1.0, 1.0]


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(0)
    x = r.normal(size=(30, 8))
    f = quality.Fourier(np.zeros(8), np.ones(8), features=6000)
    z = f(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-far / (2 * 8))).max() < 0.08


# -- 10

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<article><header><h1>Head &eacute;</h1></header><p><b>First   line<br><p>A <i>sen</i>tence &lt;b&gt; one.</p><div class="ad">Buy</div><aside>Side</aside><p>Last.</p><form>Name <input> <button>Go</button></form>
<section class="comments"><p>Nice text, reader one</p></section></article><div id="sidebar">Other</div><footer>&copy; 2024</footer></body>"""


def test_article_text():
    assert html_blocks.main_text(PAGE) == "Head é First line A sentence <b> one. Last."


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words", "plain words"), ("a < b", "a < b"), ("<nav>only menu</nav>", ""), ("<article><p>x</article>", "x"), ("<article>a<br>b<p>c &nbsp; d</p></article>", "a b c d"),
    ("<nav><a>m</a><article><p>kept</p></article>", "kept"), ("<article><p>one</p></article><article class='comment'><p>a much longer comment than the text</p></article>", "one"),
    ("<article><p>t</p><div hidden>no</div><p style='display: none'>no</p><p>u</p></article>", "t u"), ("<article><p title='a>b'>q</p></article>", "q"), ("<article><p>x&#233;&unknown;</p></article>", "xé&unknown;"),
])
def test_small_pages(html, text):
    assert html_blocks.main_text(html) == text


def test_pages_without_marked_article():
    body = "".join(f"<div>Paragraph {k} with quite some text in it, long enough to weigh.</div>" for k in range(6))
    page = f"<div><a>Home</a></div><div><a>News</a></div><div><a>More</a></div><h2>Title</h2>{body}<div>End.</div><div class='comments'><p>I like it</p></div><div class='footer'>imprint</div>"
    assert html_blocks.main_text(page) == "Title " + " ".join(f"Paragraph {k} with quite some text in it, long enough to weigh." for k in range(6)) + " End."


@pytest.mark.parametrize("html,text", [
    ('<p>a <a href="/hidden-valley">valley</a> b</p>', "a valley b"), ('<p title="the hidden cost">cost</p>', "cost"), ('<div data-hidden="false">shown</div>', "shown"), ('<p title="x" hidden>no</p><p>yes</p>', "yes"),
    ('<div class="overflow-hidden md:hidden">a</div>', "a"), ('<section id="discussion"><h2 id="search-methods">How</h2><p>b</p></section>', "How b"), ('<div class="section-header"><h2 class="header">T</h2></div><p class="form">c</p>', "T c"),
    ('<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>\\x</annotation></math> holds</p>', "so x=1 holds"), ('<p>one <span aria-hidden="true">#</span>two</p>', "one two"), ('<div class="share-buttons">no</div><div class="wide comments">no</div><p>d</p>', "d"),
    ('<div role="navigation">no</div><p>e</p>', "e"),
])
def test_names_that_only_look_like_furniture(html, text):
    assert html_blocks.main_text(f"<article>{html}</article>") == text


def test_nested_articles_are_one():
    parts = "".join(f"<article><h2>Part {k}</h2><p>Text {k}.</p><p>More {k}.</p></article>" for k in range(3))
    said = " ".join(f"Part {k} Text {k}. More {k}." for k in range(3))
    for outer in ("main", "article"):
        assert html_blocks.main_text(f"<div>out</div><{outer}><h1>Title</h1><p>Before.</p>{parts}<p>After.</p><article class='teaser'>no</article></{outer}><div>out</div>") == f"Title Before. {said} After."


def test_attributes_outside_an_article():
    assert html_blocks.main_text('<div><h2 id="search-methods">How</h2><p title="the hidden cost">Text.</p><section id="discussion"><p>More.</p></section></div><div id="sidebar">no</div><div class="site-footer">no</div>') == "How Text. More."


def test_unmarked_article_is_kept_whole():
    box = "<aside><p>one</p><p>two</p><p>three</p></aside>"
    assert html_blocks.main_text(f"<div><p>A</p><p>B</p>{box}<p>C</p><p>D</p></div>") == "A B C D"
    links = "<ul><li><a href=/1>Share</a></li><li><a href=/2>Mail</a></li><li><a href=/3>Print</a></li></ul>"
    first, last = "The first part of the text weighs enough to surge by its length alone.", "The second part, behind the list, is the heavier one of the two parts and surges."
    assert html_blocks.main_text(f"<div><h1>Title</h1>{links}<p>{first}</p>{links}<p>{last}</p>{links}<p>End.</p></div>") == f"Title {first} {last} End."
    assert html_blocks.main_text(f"<div><p>{first}</p></div>{links}<div><div><p>{last}</p></div></div>") == f"{first} {last}"


def test_surge_and_dive():
    assert html_blocks.surge_and_dive([0, 5, 0, 0, 0, 40, 50, 0, 60, 0, 0, 0, 9]) == (5, 9)
    assert html_blocks.surge_and_dive([]) == (0, 0) == html_blocks.surge_and_dive([0, 0])
    assert html_blocks.surge_and_dive([0, 3]) == (1, 2)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 7), (1, "u", PAGE, 7), (2, None, None, 7), (None, "v", "<p>é", 7), (3, "w", "<article>" + "<p>long one</p>" * 20_000 + "</article>", 7)], "page_id bigint, url string, html string, n_chars int")
    got = html_blocks.extract(df).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got[:4]] == [(1, "u", 43)] * 2 + [(2, None, 0), (None, "v", 1)]
    assert got[4].text == " ".join(["long one"] * 20_000)
    assert html_blocks.extract(df.limit(0)).count() == 0


# -- the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_passages", "source_mix", "tokens"]
    d, seen = queries.table(spark, sf, "documents"), []
    for _, stage in cp.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf).toArrow()) if d.limit(1).count() else d
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(d.count())
    assert 200 > seen[0] >= seen[1] >= seen[2] > 100
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and abs(out.count() - seen[3]) <= 2


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    r = c.execute(queries.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, r.fetchall()))

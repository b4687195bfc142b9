"""Encoding and decoding against the library over all of Unicode, and of very long texts."""

import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from weirflow.llm import prefix_bpe, queries

PATH = queries.tokenizer_file("word_bpe_49k.json")
#: newer than some tables
NEW = [0x1C89, 0xA7CB, 0x10D50, 0x16EA5, 0x11D45, 0xFE22]


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), prefix_bpe.tokenizer(PATH)


def same(both, text):
    library, ours = both
    ids = library.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    return got.tolist() == ids and ours.decode(got) == library.decode(ids, skip_special_tokens=False) and prefix_bpe.digest(ours, text)[0] == len(ids)


def test_every_assigned_character(both):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"] + NEW
    for glue in (" ", ""):
        for lo in range(0, len(points), 3000):
            assert same(both, glue.join(map(chr, points[lo : lo + 3000]))), lo


def test_random_mixtures(both):
    points = [c for c in range(0x30000) if not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xE000)] + NEW * 500
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(chr(rng.choice(points)) if rng.random() < 0.6 else rng.choice(" aB\n'sé́ÀßIİ\x1c\x85\xa0µªK<|endoftext|>") for _ in range(rng.randint(1, 40)))
        assert same(both, text), ascii(text)


def test_marks_are_ordered(both):
    assert same(both, "a︢\U00011d45 \U00011d45︢b ȩ́ ̧́") and all(same(both, chr(c)) for c in NEW)


def test_very_long_texts(both):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéß%'") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    assert same(both, " ".join(rng.choice(words) for _ in range(200_000)))
    assert same(both, "ab" * 20_000 + " " + "é!" * 5000)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Hello", 1, "x"), (None, None, 2, "y"), (1, "Hello", 1, "x")], "doc_id int, text string, n_tokens int, ids string")
    rows = prefix_bpe.encode_documents(df, PATH, with_ids=True).collect()
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in rows] == [(1, 1, "hello</w>"), (None, 0, ""), (1, 1, "hello</w>")]
    assert prefix_bpe.encode_documents(df.limit(0), PATH).count() == 0

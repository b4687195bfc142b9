"""Line blocks: windows against a plain definition, pages without marks, and pages that are long and odd."""

import re
import time
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import html_blocks


def plain_stretches(weights, window, surge):
    n = len(weights)
    width = min(window, n)
    windows = [range(i, i + width) for i in range(n - width + 1)] if n else []
    sums = {w: sum(weights[i] for i in w) for w in windows}
    level = min(surge, max(sums.values(), default=0))
    calm = {i for w in windows if sums[w] == 0 for i in w}
    out, i = [], 0
    while i < n:
        j = i
        while j < n and j not in calm:
            j += 1
        if j > i and level > 0 and any(sums[w] >= level and any(i <= k < j and weights[k] for k in w) for w in windows):
            out.append((i, j))
        i = max(j, i + 1)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 80)), max_size=40), st.integers(1, 5), st.integers(1, 90))
def test_windows_against_their_definition(weights, window, surge):
    assert html_blocks.stretches(weights, window, surge) == plain_stretches(weights, window, surge)


def without_marks(page, tags):
    return re.sub(r' (class|id|role|itemprop)="[^"]*"', "", re.sub(rf"</?({tags})\b[^>]*>", "", page))


def test_windows_find_what_marks_would_say(sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet")["html"]
    same = words = 0
    for page in pages:
        a, b = (Counter(html_blocks.main_text(x).split()) for x in (page, without_marks(page, "article|main")))
        same += sum((a & b).values())
        words += max(sum(a.values()), sum(b.values()))
    assert same >= 0.95 * words


def test_marks_only_take_weight_away():
    long = "Quite a long paragraph of the real text, which no teaser of this page comes near to. " * 8
    page = f"<article class='x'><p>Teaser</p></article><div><h1>Title</h1><p>{long}</p><p>{long}</p></div>"
    assert html_blocks.main_text(page) == " ".join(f"Title {long} {long}".split())
    # a list of links ends the article, one inside it does not
    links = "<ul>" + "<li><a href=/1>Some other page</a></li>" * 4 + "</ul>"
    said = " ".join(["Some other page"] * 4)
    assert html_blocks.main_text(f"<main>{links}<h1><a href=/x>Title</a></h1><p>{long}</p>{links}<p>{long}</p>{links}</main>") == " ".join(f"Title {long} {said} {long}".split())
    assert html_blocks.main_text("<article><p><a href=/x>only a link</a></p></article>") == "only a link"


def test_text_of_one_element():
    long = "A paragraph that weighs enough to surge all by itself, however short the page. " * 12
    page = f"<div>Words of a notice that nothing marks, in one line of their own.</div><h1>Title</h1><div><div><p>{long}</p></div><div><p>{long}</p></div></div><div>Imprint and so on, of some length as well</div>"
    assert html_blocks.main_text(page) == " ".join(f"Title {long} {long}".split())


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a x='" * 170_000, '<a "> "' * 140_000 + "'", "<div>" * 100_000 + "</x>" * 100_000, "<i>" * 150_000 + "</b>" * 150_000, "<b><div>" + "<i>" * 150_000 + "</b>" * 150_000, "<i>" * 100_000 + "<br>x" * 100_000,
    "<!--" * 250_000, "<script>" + "</script " * 110_000, "<nav>" + "<body>" * 150_000, "<article class=comment>" + "<article>x" * 90_000, "&#" + "9" * 900_000 + ";", "<" * 1_000_000, "<a " + 'x="' * 300_000 + ">", "<div>x" * 150_000,
], ids=range(15))
def test_long_odd_pages_take_linear_time(page):
    began = time.process_time()
    html_blocks.main_text(page)
    assert time.process_time() - began < 20  # what is quadratic takes minutes


@pytest.mark.parametrize("page,text", [
    ("<!-->a", "a"), ("<!--->b", "b"), ("<!-- x -->c", "c"), ("<!-- x", ""), ("x<!-- y --", "x"), ('a<a href="x', "a"), ("<p>x</p", "x"), ("if a<3 and b>4", "if a<3 and b>4"), ("<SCRIPT>x</scripty>z</script >w", "w"), ("<p title='x>y'>z", "z"), ("<p title='x>y>z", "y>z"),
    ("<p>&#" + "1" * 5000 + ";</p>", "�"),
])
def test_odd_markup(page, text):
    assert html_blocks.main_text(page) == text


def test_one_very_long_text():
    body = "word " * 400_000
    assert html_blocks.main_text(f"<nav><a>m</a></nav><p>{body}</p>") == body.strip()


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 1)], "page_id int, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_blocks.extract(df).collect()] == [(1, "u", "x", 1)]
    assert html_blocks.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]

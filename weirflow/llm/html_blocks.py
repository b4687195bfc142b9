"""Main-text extraction by line-block distribution.

Markup is stripped so that every block element is one line.  A line weighs as many characters as
it has outside links.  Marks only take weight away: page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) is stripped like markup, and where the page
marks its article, lines outside of it weigh nothing, unless the marked element has less than a
tenth of the page's text, as a teaser has.

Weights are summed over sliding windows of ``WINDOW`` lines.  A window that weighs nothing is calm;
calm windows cut the lines into stretches.  The text *surges* in a stretch where a window's sum
reaches ``SURGE`` (or the page's greatest sum, if that is less) and *dives* at the calm window
behind it.  Inside a marked article all lines between the first surge and the last dive are kept.
On other pages every stretch that surges is kept without the weightless lines at its ends, and so
are lines with weight that share a block with a kept line; what then stands outside the innermost
element that holds nine tenths of the kept weight goes, but for headings right before it.

Pages are read by one forward scan, whose time grows in proportion to the page whatever is left
unclosed in it.

Defined results: null or empty html, or a page without any text, gives the empty string; a page or
article of nothing but links keeps an article's links and no others.  Very long pages are read
whole, in memory of some times their length.  Of elements with equal weight the first is the
article.  Pages repeat or share ids freely; each row is judged alone, ties between rows do not
arise; an empty table gives no rows.  Stray ``<``, unclosed tags and comments and unknown entities
are taken as browsers take them; a number reference of thousands of digits is U+FFFD.  Columns other
than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, and the window sum at which text surges.
WINDOW, SURGE = 3, 60
#: Share of the page's weight below which a marked article is none; share of kept weight that the text's element holds.
TEASER, HOLDS = 0.1, 0.9
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes up to what cannot be one: the tag's end, a quote that is not closed, or the page's end.
_QUOTED = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+")
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_LONG_NUMBER = re.compile(r"&#\d{4000,};?")

# Element names of HTML by their part in a page.
RAW = frozenset("script style textarea title noscript iframe noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head nav footer aside form menu dialog template svg annotation annotation-xml canvas audio video object button select datalist fieldset map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom".split())
#: Elements that hold others, whose whole class names are hints even inside the article.
CONTAINERS = frozenset("div section article aside nav header footer main ul ol dl table figure center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark page furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay toast "
    "sidebar aside rail widget widgets menu nav navbar navigation topnav topbar breadcrumb breadcrumbs pagination pager toc skip header masthead footer foot copyright legal colophon "
    "comment comments respond reply replies disqus discussion responses share sharing social related recommended recommendations trending popular teaser teasers newsletter subscribe subscription signup login search form tags".split()
)
ROLES = HINTS | {"complementary", "contentinfo", "dialog"}
#: Whole class names that mark furniture inside an article though their words alone do not.
WHOLE = HINTS | frozenset("comments-area comments-section comment-section comment-list comment-body comment-form share-buttons social-share related-posts related-articles ad-slot ad-container newsletter-signup cookie-notice cookie-banner post-navigation".split())


def _hints(attrs: str, name: str, inside: bool) -> tuple[bool, bool]:
    """Whether the attributes of an element mark furniture, and whether they mark main text.

    Names of headings and inline elements say nothing.  Inside an article, and on blocks that are no
    containers, only whole class names count; ids count on containers outside an article, but not on
    headings and sections, whose ids are made from their titles.
    """
    bad = good = False
    holds, named = name in CONTAINERS, name not in HEADINGS and name not in INLINE
    seen = set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in seen:  # the first counts
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            bad = True
        elif key == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
        elif key in ("class", "id", "role"):
            value = value.lower()
            names = set(value.split())
            parts = {p for p in re.split(r"[^a-z]+", value) if p}
            if not parts & {"article", "main", "articlebody"}:
                if key == "role":
                    bad |= bool(names & ROLES)
                elif key == "class" and (inside or not holds):
                    bad |= named and (holds or not inside) and bool(names & WHOLE)
                elif holds and not (key == "id" and (inside or name == "section")):
                    bad |= bool(parts & HINTS)
            good |= value == "main" or bool(parts & {"articlebody", "main"}) or any({x, "content"} <= parts for x in ("article", "post", "entry"))
        elif key == "itemprop":
            good |= value.lower() == "articlebody"
    return bad, good


class Line:
    """A block's text, its characters in links, whether it is furniture or a heading, and the numbers of its article and its block."""

    __slots__ = ("article", "block", "furniture", "heading", "linked", "parts", "said")

    def __init__(self, furniture: bool, article: int, block: int, heading: bool):
        self.parts: list[str] = []
        self.said, self.linked = "", 0
        self.furniture, self.article, self.block, self.heading = furniture, article, block, heading


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name, whether closing, attributes of every tag; comments and the like have no name.

    Where a quote is not closed, a tag ends at the next ``>`` all the same.  ``unclosed`` is the place up
    to which tags are known to run into such a quote, so that it is looked for once.
    """
    at, n, unclosed = page.find("<"), len(page), -1
    while at >= 0:
        begin = at + 1
        closing = page.startswith("/", begin)
        m = _NAME.match(page, begin + closing)
        if m:
            end = _QUOTED.match(page, m.end()).end() if at >= unclosed else -1
            if end < 0 or end == n or page[end] != ">":
                unclosed = max(unclosed, end)
                end = page.find(">", m.end())
            name, attrs = m[0].lower(), page[m.end() : end] if end >= 0 else ""
        elif page.startswith("!--", begin):
            # "<!-->" and "<!--->" are whole comments
            end = page.find(">", begin + 3) if page.startswith((">", "->"), begin + 3) else page.find("-->", begin + 3)
            end, name, attrs = end + 2 if page.startswith("-->", end) and end > begin + 2 else end, "", ""
        elif closing or page.startswith(("!", "?"), begin):
            end, name, attrs = page.find(">", begin), "", ""
        else:
            at = page.find("<", begin)
            continue
        if end < 0:
            end = n - 1  # what is not closed reaches to the end
            name = ""
        skip = yield at, end + 1, name, closing, attrs
        at = page.find("<", max(end + 1, skip or 0))


def lines_of(page: str) -> tuple[list[Line], list[int]]:
    """The page's lines in order, and of each block the number of the one around it (block 0 is the page)."""
    out: list[Line] = []
    now = Line(False, 0, 0, False)
    #: open elements: name, whether furniture starts here, article and block before it
    stack: list[tuple[str, bool, int, int]] = []
    around = [0]
    #: how many elements of a name are open: all, and formatting since the last open block
    open_names: dict[str, int] = {}
    inline: list[dict[str, int]] = [{}]
    bad = boxes = links = articles = article = block = heads = 0
    removed: dict[str, re.Pattern] = {}

    def fresh() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Line(bad > 0, article, block, heads > 0)

    def text(s: str) -> None:
        if s and now.furniture and not bad:
            fresh()
        # furniture inside a line is left out of it
        if s and (now.furniture or not bad):
            now.parts.append(s)
            if links:
                now.linked += len(s)

    def boxed(name: str, furniture: bool) -> bool:
        return furniture and (name in FURNITURE or name in ("header", "div"))

    def pop() -> None:
        nonlocal bad, boxes, links, article, block, heads
        name, was_bad, was, block = stack.pop()
        bad -= was_bad
        boxes -= boxed(name, was_bad)
        links -= name == "a"
        heads -= name in HEADINGS
        open_names[name] -= 1
        article = was
        if name in INLINE:
            inline[-1][name] -= 1
        else:
            inline.pop()

    at, reader, skip = 0, tags(page), None
    while True:
        try:
            begin, end, name, closing, attrs = reader.send(skip)
        except StopIteration:
            text(page[at:])
            break
        skip = None
        text(page[at:begin])
        at = end
        if not name:
            continue
        if closing:
            if name not in INLINE:
                fresh()
            # an end tag closes its element and what is open inside; a formatting tag reaches no further than its block
            if (inline[-1] if name in INLINE else open_names).get(name, 0):
                while stack[-1][0] != name:
                    pop()
                pop()
            if name not in INLINE:
                fresh()
            continue
        if name in RAW:
            if name not in removed:
                removed[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)
            over = removed[name].search(page, at)
            at = skip = (over and page.find(">", over.end()) + 1) or len(page)
            if name not in INLINE:
                fresh()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                fresh()
            continue
        if name not in INLINE:
            # a block ends open paragraphs and formatting; list items and cells end their kind
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                pop()
            # furniture left open does not swallow the article
            while boxes and name in ("main", "body"):
                pop()
            if name == "article" and bad and bad == open_names.get("nav", 0) + open_names.get("header", 0) + open_names.get("head", 0):
                while bad:
                    pop()
        furniture, main = _hints(attrs, name, article > 0) if attrs.strip(" /") else (False, False)
        if name in ("html", "body", "main", "article") and not (name == "article" and furniture and re.search(r"comment|teaser|related|promo|sponsor", attrs, re.I)):
            furniture = False
        furniture |= name in FURNITURE or name == "header" and not article
        if furniture and attrs.rstrip().endswith("/") and name not in ("div", "section"):
            continue
        stack.append((name, furniture, article, block))
        open_names[name] = open_names.get(name, 0) + 1
        bad += furniture
        boxes += boxed(name, furniture)
        links += name == "a"
        heads += name in HEADINGS
        if (name in ("article", "main") or main) and not bad and not article:
            articles += 1
            article = articles
        if name in INLINE:
            inline[-1][name] = inline[-1].get(name, 0) + 1
        else:
            inline.append({})
            around.append(block)
            block = len(around) - 1
            fresh()
    fresh()
    done = []
    for x in out:
        x.said = " ".join(_html.unescape(_LONG_NUMBER.sub("�", "".join(x.parts))).split())
        if x.said:
            x.linked = min(x.linked, len(x.said))
            done.append(x)
    return done, around


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and last-plus-one line of each stretch between calm windows in which the text surges."""
    n = len(weights)
    width = min(window, n)
    sums, total = [], sum(weights[:width])
    for i in range(n - width + 1 if n else 0):
        sums.append(total)
        if i + width < n:
            total += weights[i + width] - weights[i]
    level = min(surge, max(sums, default=0))
    if level <= 0:
        return []
    calm = [0] * (n + 1)
    for i, s in enumerate(sums):
        if s == 0:
            calm[i] += 1
            calm[i + width] -= 1
    found, begin, depth, high = [], None, 0, False
    for i in range(n + 1):
        depth += calm[i]
        if i == n or depth:
            if begin is not None and high:
                found.append((begin, i))
            begin, high = None, False
        else:
            if begin is None:
                begin = i
            # the windows that hold line i
            high |= weights[i] > 0 and any(s >= level for s in sums[max(0, i - width + 1) : i + 1])
    return found


def trimmed(weights: list[int], begin: int, end: int) -> tuple[int, int]:
    """The stretch without the weightless lines at its ends."""
    while begin < end and not weights[begin]:
        begin += 1
    while end > begin and not weights[end - 1]:
        end -= 1
    return begin, end


def surge_and_dive(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """The stretch of text with most weight (0, 0: none)."""
    found = [trimmed(weights, *x) for x in stretches(weights, window, surge)]
    return max(found, key=lambda x: sum(weights[x[0] : x[1]]), default=(0, 0))


def _weight(line: Line) -> int:
    """Characters outside links, none if most are in links."""
    return 0 if 2 * line.linked > len(line.said) else len(line.said) - line.linked


def _in_element(lines: list[Line], weights: list[int], around: list[int], holds: float) -> list[bool]:
    """Which lines stand in the innermost element with the given share of the weight, or are headings right before it."""
    inside = [0] * len(around)
    for x, w in zip(lines, weights, strict=True):
        inside[x.block] += w
    for k in range(len(around) - 1, 0, -1):
        inside[around[k]] += inside[k]
    home = max(k for k in range(len(around)) if inside[k] >= holds * inside[0])
    under = [False] * len(around)
    for k in range(len(around)):
        under[k] = k == home or (k > 0 and under[around[k]])
    keep = [under[x.block] for x in lines]
    for i in range(len(lines) - 2, -1, -1):
        keep[i] |= keep[i + 1] and lines[i].heading
    return keep


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text; its blocks joined by one space."""
    if not page:
        return ""
    lines, around = lines_of(page)
    lines = [x for x in lines if not x.furniture]
    weights = [_weight(x) for x in lines]
    by_article: dict[int, int] = {}
    for x, w in zip(lines, weights, strict=True):
        if x.article:
            by_article[x.article] = by_article.get(x.article, 0) + w
    marked = max(by_article, key=lambda k: (by_article[k], -k), default=0)
    if marked and by_article[marked] >= TEASER * sum(weights):
        lines = [x for x in lines if x.article == marked]
        # in an article, a title that is a link is text, and so is everything if all of it is links
        bare = not by_article[marked]
        found = stretches([len(x.said) if bare or x.heading else len(x.said) - x.linked for x in lines], window, surge)
        return " ".join(x.said for x in lines[found[0][0] : found[-1][1]]) if found else ""
    found = [trimmed(weights, *x) for x in stretches(weights, window, surge)]
    kept = {i for begin, end in found for i in range(begin, end)}
    # a line shares a block with a kept one if it stands in the same block, or its block in that or the same one
    homes = {b for i in kept if weights[i] for b in (around[lines[i].block],)}
    kept |= {i for i, x in enumerate(lines) if weights[i] and (x.block in homes or around[x.block] in homes)}
    some = sorted(kept)
    if not some:
        return ""
    keep = _in_element([lines[i] for i in some], [weights[i] for i in some], around, HOLDS)
    return " ".join(lines[i].said for i, k in zip(some, keep, strict=True) if k)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, window, surge) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, SCHEMA)

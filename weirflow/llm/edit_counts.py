"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold short runs of pre-tokens (their
text, lengths and token counts), inner nodes the sums of characters and tokens below them.  An edit
finds its leaf by descending on characters, re-splits and re-encodes only from the first pre-token
that can see the edit to the first old boundary behind it, and updates the sums on the way up.  Only
the text around an edit is read.  A leaf that grows too long becomes several, and a subtree that
gets lopsided is built anew, so that an edit costs the logarithm of the text's length and what it touches.

Splitting looks ahead two characters at most past a pre-token and never back, so pre-tokens that
end two characters before an edit stand, and so does everything from an old boundary that the new
split meets again.

Defined results: a null text counts as empty; edits apply one after the other, each to the text as
it then is, with places cut to the text's ends; edits at the same place are no ties, they go in the
order given; a null list of edits is empty, null edits are left out, of an edit's nulls a place is 0,
a length 0 and what is put the empty string.  Texts of any length are read whole.  Repeated rows are
counted each by itself; an empty table gives no rows.  Columns other than doc_id, text and edits are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-tokens of a leaf, when built; a leaf that grows to four times as many is cut up.
LEAF = 32
#: Pieces whose counts a worker keeps.
KEEP = 500_000
#: How far past its end the split of a pre-token looks.
LOOK = 2


class Counter:
    """Token counts of pre-tokens by a rank file, and the pattern that splits text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding._encode_single_piece(piece))
            if len(piece) <= 64:
                if len(self.known) >= KEEP:
                    self.known.clear()
                self.known[piece] = n
        return n

    def split(self, text: str) -> tuple[list[int], list[int]]:
        pieces = self.pattern.findall(text)
        known = self.known
        try:
            return list(map(len, pieces)), [known[p] for p in pieces]
        except KeyError:
            return list(map(len, pieces)), [self.count(p) for p in pieces]


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class _Node:
    """A leaf (text, sizes, counts) or two children; the sums below it."""

    __slots__ = ("chars", "counts", "leaves", "left", "right", "sizes", "text", "tokens")

    def __init__(self, text: str = "", sizes: list[int] | None = None, counts: list[int] | None = None):
        self.left = self.right = None
        self.leaves = 1
        self.fill(text, sizes or [], counts or [])

    def fill(self, text: str, sizes: list[int], counts: list[int]) -> None:
        self.text, self.sizes, self.counts = text, sizes, counts
        self.chars, self.tokens = len(text), sum(counts)

    def join(self, left: _Node, right: _Node) -> _Node:
        self.left, self.right, self.text, self.sizes, self.counts = left, right, "", [], []
        self.add()
        return self

    def add(self) -> None:
        a, b = self.left, self.right
        self.chars, self.tokens, self.leaves = a.chars + b.chars, a.tokens + b.tokens, a.leaves + b.leaves


def _cut(text: str, sizes: list[int], counts: list[int]) -> list[_Node]:
    """Leaves of ``LEAF`` pre-tokens."""
    out, at = [], 0
    for i in range(0, len(sizes), LEAF):
        n = sum(sizes[i : i + LEAF])
        out.append(_Node(text[at : at + n], sizes[i : i + LEAF], counts[i : i + LEAF]))
        at += n
    return out or [_Node()]


def _balanced(leaves: list[_Node]) -> _Node:
    while len(leaves) > 1:
        pairs = [_Node().join(leaves[i], leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0]


def _leaves(node: _Node) -> list[_Node]:
    out, stack = [], [node]
    while stack:
        node = stack.pop()
        if node.left is None:
            out.append(node)
        else:
            stack += (node.right, node.left)
    return out


class TokenTree:
    """The pre-tokens of one text under edits."""

    def __init__(self, text: str, how: Counter):
        self.how, self.reencoded, self.read = how, 0, 0
        sizes, counts = how.split(text)
        self._first, self._total = (text, sizes, counts), sum(counts)
        self._root: _Node | None = None  # made with the first edit

    @property
    def total(self) -> int:
        return self._root.tokens if self._root else self._total

    @property
    def text(self) -> str:
        return "".join(x.text for x in _leaves(self._root)) if self._root else self._first[0]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """Number and beginning of the leaf that holds character ``at`` (the last one with any, past the end)."""
        node, begin, number = self._root, 0, 0
        at = min(at, max(0, node.chars - 1))
        while node.left is not None:
            if at - begin >= node.left.chars and node.right.chars:
                begin, number, node = begin + node.left.chars, number + node.left.leaves, node.right
            else:
                node = node.left
        return number, begin

    def _path(self, number: int) -> list[_Node]:
        node = self._root
        path = [node]
        while node.left is not None:
            if number < node.left.leaves:
                node = node.left
            else:
                number, node = number - node.left.leaves, node.right
            path.append(node)
        return path

    def _put(self, number: int, text: str, sizes: list[int], counts: list[int]) -> None:
        """Gives a leaf other contents.  Only if it is cut up do numbers of leaves change."""
        *above, leaf = self._path(number)
        grown = len(sizes) > 4 * LEAF
        if grown:
            part = _balanced(_cut(text, sizes, counts))
            leaf.join(part.left, part.right)
        else:
            leaf.fill(text, sizes, counts)
        lopsided = None
        for node in reversed(above):
            node.add()
            if grown and max(node.left.leaves, node.right.leaves) > 0.75 * node.leaves + 2:
                lopsided = node
        if lopsided is not None:
            whole = _balanced([x for x in _leaves(lopsided) if x.sizes] or [_Node()])
            if whole.left is None:
                lopsided.left = lopsided.right = None
                lopsided.leaves = 1
                lopsided.fill(whole.text, whole.sizes, whole.counts)
            else:
                lopsided.join(whole.left, whole.right)
            for node in reversed(above[: above.index(lopsided)]):
                node.add()

    def edit(self, start: int, length: int, put: str) -> None:
        """Replaces ``length`` characters from ``start`` by ``put``."""
        if self._root is None:
            self._root = _balanced(_cut(*self._first))
            self._first = None
        size = self._root.chars
        start = min(max(start, 0), size)
        stop = min(start + max(length, 0), size)
        shift = len(put) - (stop - start)
        # the first pre-token whose end, and what its split looks at, comes up to the edit
        first, begin = self._leaf_at(max(0, start - LOOK))
        leaf = self._path(first)[-1]
        inside, from_ = 0, begin
        while inside < len(leaf.sizes) and from_ + leaf.sizes[inside] + LOOK <= start:
            from_ += leaf.sizes[inside]
            inside += 1
        head = leaf.text[: from_ - begin], leaf.sizes[:inside], leaf.counts[:inside]
        # split the new text from there, a few leaves of it at a time, until it meets an old boundary at or behind the edit
        window, boundary, last, l, i = [], from_, first - 1, first, inside
        have = 0  # characters of the old text in the window
        got_sizes, got_counts, at, met = [], [], 0, False
        wanted, texts = 1, []
        new = ""
        while not met:
            while last + 1 < self._root.leaves and (wanted > 0 or from_ + have < stop + LOOK):
                last += 1
                wanted -= 1
                x = self._path(last)[-1]
                texts.append(x)
                window.append(x.text if last > first else x.text[from_ - begin :])
                have += len(window[-1])
            wanted = len(texts)
            old = "".join(window)
            new = old[: start - from_] + put + old[stop - from_ :]
            self.read += len(new) - at
            end = from_ + have == size
            for m in self.how.pattern.finditer(new, at):
                if not end and m.end() + LOOK > len(new):
                    break  # what lies behind could change it
                got_sizes.append(m.end() - m.start())
                got_counts.append(self.how.count(m[0]))
                at = m.end()
                here = from_ + at - shift  # in the old text
                while boundary < max(here, stop) and l <= last:
                    sizes = texts[l - first].sizes
                    if i < len(sizes):
                        boundary += sizes[i]
                        i += 1
                    else:
                        l, i = l + 1, 0
                if here >= stop and boundary == here:
                    met = True
                    break
            else:
                if end:
                    l, i, met = self._root.leaves, 0, True
        self.reencoded += len(got_sizes)
        said = new[: sum(got_sizes)]
        # what stays: the head of the first leaf and the tail of leaf l from its pre-token i
        tail = ("", [], [])
        if l <= last:
            x = texts[l - first]
            tail = x.text[sum(x.sizes[:i]) :], x.sizes[i:], x.counts[i:]
        for k in range(min(l, last), first, -1):
            self._put(k, *(tail if k == l else ("", [], [])))
        parts = (head[0] + said, head[1] + got_sizes, head[2] + got_counts)
        self._put(first, *(tuple(a + b for a, b in zip(parts, tail, strict=True)) if l == first else parts))


#: What the default edits replace. Repeats are bounded, so that time is linear in the text's length.
REDACTIONS = (
    (r"[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}", "<email>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"\+?\d[\d ()-]{7,30}\d", "<phone>"),
    (r"\b[A-Za-z0-9_-]{24,}\b", "<secret>"),
)
_REDACT = re.compile("|".join(f"({p})" for p, _ in REDACTIONS))


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace personal data and secrets, last first, so that earlier places stay as they are."""
    return [(m.start(), m.end() - m.start(), REDACTIONS[m.lastindex - 1][1]) for m in _REDACT.finditer(text)][::-1]


def count_edited(documents: DataFrame, path: str, pattern: str, edits: str | Callable[[str], list] = redactions) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded (pre-tokens encoded again).

    ``edits`` names a column of array<struct<start, length, put>> or is a function of the text.
    """
    column = edits if isinstance(edits, str) else None
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", *([f"{column} as edits"] if column else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = counter(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                given = part.column("edits").to_pylist() if column else None
                out = np.zeros((part.num_rows, 4), dtype=np.int64)
                for k, text in enumerate(part.column("text").to_pylist()):
                    text = text or ""
                    todo = [(e["start"] or 0, e["length"] or 0, e["put"] or "") for e in given[k] or [] if e] if column else edits(text)
                    tree = TokenTree(text, how)
                    out[k, 0] = tree.total
                    for e in todo:
                        tree.edit(*e)
                    out[k, 1:] = len(todo), tree.total, tree.reencoded
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[:, k]) for k in range(4))], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_reencoded bigint")

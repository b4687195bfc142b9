"""Byte-pair encoding and decoding by per-prefix dynamic programming.

For a word, the last token of the encoding of each prefix is unique.  An automaton over the
vocabulary gives, for each prefix, the tokens that are its suffixes; token t is the last one of
prefix p if the rest of p is empty (and t encodes to itself) or the rest's own last token and
t are *compatible*: merging their joint string gives just the two.  One left-to-right pass stores
the last token of each prefix; back-pointers from the end emit the ids.  Time is linear in the
word's length, whatever the order of merges.

Normal forms, lower case and the splitting of what is not Latin-1 come from the tokenizers library;
the ids of each word come from the method above.

Defined results: a null or empty text has no ids and decodes to the empty string; texts of any
length are read whole, word by word; repeated rows are encoded each by itself; of overlapping added
tokens the longest that starts first counts; an empty table gives no rows.  Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words whose ids a worker keeps; beyond it the table starts anew, so memory is bounded.
KEEP = 200_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

_VISIBLE = re.compile("[!-~]*").fullmatch
_LATIN = re.compile("[\x00-\x7f\xa1-\xff]*").fullmatch
_CONTROL = regex.compile("[\x1c-\x1f]")
# Fixed value: white space by Unicode.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class PrefixBPE:
    """A vocabulary with ranked merges; ``end`` marks the last symbol of a word."""

    #: Word-final symbols are these private-use characters inside the class.
    FINAL = 0xF0000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = end
        inner = {t: self._inner(t) for t in vocab}
        self.ids = {inner[t]: i for t, i in vocab.items()}
        self.outer = {i: t for t, i in vocab.items()}
        self.rank = {(self._inner(a), self._inner(b)): n for n, (a, b) in enumerate(merges)}
        #: the same for ids, a pair being one number
        self._rank_of = {self.ids[a] << 32 | self.ids[b]: n for (a, b), n in self.rank.items()}
        self._pairs: dict[int, bool] = {}
        #: of each token, what stands at its right (left) edge while it is merged, and the rank at which that is used up
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            split = self._last_merge(t)
            if split is None:
                continue  # merging its symbols does not give it: it is in no encoding
            if len(t) == 1:
                self._right[i] = self._left[i] = ((i, 1 << 60),)
            else:
                a, b, n = split
                self._right[i] = (*self._right[b][:-1], (b, n), (i, 1 << 60))
                self._left[i] = (*self._left[a][:-1], (a, n), (i, 1 << 60))
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()

    def _inner(self, token: str) -> str:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(self.FINAL + ord(body[-1]))
        return token

    def _last_merge(self, s: str) -> tuple[int, int, int] | None:
        """The merge (left id, right id, rank) that ends plain merging of ``s``, if it ends in one token."""
        if len(s) == 1:
            return (-1, -1, -1)
        parts, done = list(s), None
        while len(parts) > 1:
            n, k = min((self.rank.get((parts[k], parts[k + 1]), 1 << 60), k) for k in range(len(parts) - 1))
            if n == 1 << 60:
                return None
            done = (self.ids[parts[k]], self.ids[parts[k + 1]], n)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return done

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint string of two tokens gives just the two: no merge crosses their border.

        Both edges are followed through their merges by rank; a pair that stands at the border merges
        across it if its rank comes before either side is used up (of equal ranks the left one is first).
        """
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is not None:
            return known
        if len(self._pairs) >= 400_000:
            self._pairs.clear()
        right, left, i, j, known = self._right[a], self._left[b], 0, 0, True
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            n = self._rank_of.get(x << 32 | y)
            if n is not None and n < x_until and n <= y_until:
                known = False
                break
            if i + 1 == len(right) and j + 1 == len(left):
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        self._pairs[key] = known
        return known

    def encode_word(self, symbols: str) -> list[int]:
        """The ids of one word given as symbols (without the end mark)."""
        if not symbols:
            return []
        word = symbols[:-1] + chr(self.FINAL + ord(symbols[-1])) if self.end else symbols
        last: list[tuple | None] = [None] * (len(word) + 1)
        known, compatible, done = self._pairs.get, self.compatible, -1
        for stop, token in self.automaton.iter(word):
            # the automaton gives all matches that end at one place one after the other
            if stop == done:
                continue
            i, size = token
            before = last[stop + 1 - size]
            if before is None:
                if size <= stop:
                    continue
            else:
                fits = known(before[0] << 32 | i)
                if fits is None:
                    fits = compatible(before[0], i)
                if not fits:
                    continue
            last[stop + 1] = token
            done = stop
        out, at = [], len(word)
        while at:
            token = last[at]
            if token is None:
                raise ValueError("a symbol of the word is not in the vocabulary")
            out.append(token[0])
            at -= token[1]
        return out[::-1]


class _Memo(dict):
    """A table filled on demand that starts anew at ``KEEP`` entries and does not keep long keys."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= KEEP:
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """The pipeline around the word encoder: added tokens, NFC, lower case, splitting, byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.bpe = PrefixBPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # beyond Latin-1, composed forms, lower case and letters are those of the library's own tables
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._normalize, self._pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._split = regex.compile(pattern.replace("\\s", _WS))
        self._symbols = byte_symbols()
        self._words = _Memo(self._word)
        self._chunks = _Memo(self._chunk)

    def _word(self, symbols: str) -> tuple[bytes, bytes]:
        ids = self.bpe.encode_word(symbols)
        raw = array("I", ids)
        if sys.byteorder == "big":
            raw.byteswap()
        return raw.tobytes(), " ".join(map(self.bpe.outer.__getitem__, ids)).encode("utf-8")

    def _as_symbols(self, word: str) -> str:
        return "".join(map(self._symbols.__getitem__, word.encode("utf-8")))

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and decoded words of a stretch without white space, which no word crosses."""
        if _LATIN(chunk):
            # composed already, and of the same lower case and classes by every table
            low = chunk.lower()
            if low.isalpha():
                return self._words[low if low.isascii() else self._as_symbols(low)]
            words = [w if _VISIBLE(w) else self._as_symbols(w) for w in self._split.findall(low)]
        else:
            words = [w for w, _ in self._pre_tokenize(self._normalize(chunk))]
        found = [self._words[w] for w in words]
        if len(found) == 1:
            return found[0]
        return b"".join([x[0] for x in found]), b" ".join([x[1] for x in found])

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self._added.finditer(text) if self._added else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def pieces(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded words in text order, some thousand words at a time."""
        for part, special in self._segments(text):
            if special:
                yield np.array([self.added[part]], dtype="<u4").tobytes(), part.encode("utf-8")
                continue
            # str.split() also cuts at four control characters that are no white space here
            chunks = part.split() if not _CONTROL.search(part) else regex.split(f"[{_WS}]+", part)
            for i in range(0, len(chunks), 8192):
                found = list(map(self._chunks.__getitem__, chunks[i : i + 8192]))
                ids = b"".join([x[0] for x in found])
                if ids:
                    yield ids, b" ".join([x[1] for x in found if x[0]])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(x[0] for x in self.pieces(text or "")), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        names = {i: t for t, i in self.added.items()}
        return " ".join(names[i] if i in names else self.bpe.outer[i] for i in map(int, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def digest(t: WordTokenizer, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids (little-endian, 32 bits), SHA-256 of the decoded text."""
    n, ids, said = 0, hashlib.sha256(), hashlib.sha256()
    for raw, names in t.pieces(text or ""):
        ids.update(raw)
        said.update(b" " + names if n else names)
        n += len(raw) >> 2
    return n, ids.hexdigest(), said.hexdigest()


def encode_documents(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; ``with_ids`` adds ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column("text").to_pylist()
                rows = [digest(t, x) for x in texts]
                cols = [part.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ids = [t.encode(x) for x in texts]
                    cols += [pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), pa.array([t.decode(x) for x in ids], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = SCHEMA + (", ids array<bigint>, decoded string" if with_ids else "")
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)

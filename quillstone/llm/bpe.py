"""Byte-level byte-pair encoding: exact token counts and ids without the tokenizer's own loop.

`count_tokens` counts by merging alone: the symbols of a word form a doubly linked list, a heap
holds the adjacent pairs by merge rank, and every popped pair that still stands removes one
symbol. The count is initial symbols minus merges; no identifiers are made.

`Ids` gives the identifiers themselves, for operators that store tokens.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import slices

#: Words that a generation of a worker's cache holds, and the longest that is kept: about 130 MB at most.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: White space as the tokenizer's pattern understands it (Unicode's White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEYOND = re.compile("[\u0250-\U0010ffff]")


def _latin(kind: str) -> str:
    """The ranges of code points below U+0250 in a general category, for a character class."""
    points = [i for i in range(0x250) if regex.match(rf"\p{{{kind}}}", chr(i))]
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def _pattern(letter: str, number: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
        rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


#: Two spellings of one pattern: the first is faster and serves texts below U+0250.
_NEAR = re.compile(_pattern(_latin("L"), _latin("N")))
_FAR = regex.compile(_pattern(r"\p{L}", r"\p{N}"))


def words(text: str) -> list[str]:
    """The pieces inside which merges happen; joined they give the text back."""
    return (_FAR if _BEYOND.search(text) else _NEAR).findall(text)


def word_runs(text: str, run: int = 200_000) -> Iterator[list[str]]:
    """As `words`, in bounded lists, so that a very long text needs no list of all its words."""
    if len(text) <= 4 * run:
        yield words(text)
        return
    found = (_FAR if _BEYOND.search(text) else _NEAR).finditer(text)
    while part := [m.group() for m in islice(found, run)]:
        yield part


@functools.cache
def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Merge ranks of a byte-level BPE file of the tokenizers library, and its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number: dict[str, int] = {}
        known = lambda s: number.setdefault(s, len(number))
        self.first = [known(c) for c in byte_letters()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault(known(a) << 32 | known(b), i)
            self.made.append(known(a + b))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges, by popping the pair of lowest rank again and again."""
        rank, made, sym = self.rank.get, self.made, [self.first[b] for b in word]
        n = left = len(sym)
        if n < 2:
            return n
        # a heap entry is one number, rank << 40 | position: lowest rank first, then leftmost
        heap = [r << 40 | i for i in range(n - 1) if (r := rank(sym[i] << 32 | sym[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r = heappop(heap)
            i, r = r & 0xFF_FFFF_FFFF, r >> 40
            j = after[i]
            if j >= n or rank(sym[i] << 32 | sym[j]) != r:
                continue  # one of the two has gone into another merge
            one = sym[i] = made[r]
            sym[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(one << 32 | sym[k])) is not None:
                    heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0 and (r := rank(sym[h] << 32 | one)) is not None:
                heappush(heap, r << 40 | h)
        return left


class Kept(dict):
    """A dict that makes missing values and holds two generations of CACHE_WORDS at most."""

    older: dict = {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        return self.keep(word, value) if len(word) <= CACHE_CHARS else value

    def keep(self, key, value):
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Counts(Kept):
    """Token counts of words, made on first sight."""

    def __init__(self, merges: MergeTable):
        super().__init__()
        self.merges = merges

    def make(self, word: str) -> int:
        return self.merges.count(word.encode())


@functools.lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(MergeTable(path))


def count_text(text: str, path: str) -> int:
    """Tokens of one text; special strings inside it are one token each, as the library reads them."""
    counts = _counts(path)
    total, parts = 0, [text]
    for special in counts.merges.special:
        if special in text:
            parts = [x for p in parts for x in p.split(special)]
            total += text.count(special)
    return total + sum(sum(map(counts.__getitem__, run)) for p in parts for run in word_runs(p))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, and whether n_tokens exceeds `limit`.

    One pass without a shuffle; a lost task is simply run again. A null text counts as empty
    (0 bytes, 0 tokens), a null doc_id stays null, repeated rows each keep their row, other
    columns are not read. `vocabulary` is a path that exists on every executor.
    """

    def run(batches):
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count_text(t, vocabulary) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian 16-bit numbers."""
    packed = array("H", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Ids(Kept):
    """Token ids of words as packed little-endian 16-bit numbers.

    `ranks` is the rank file of the same vocabulary (its lines are base64 bytes and an id);
    `special` maps special strings to their ids.
    """

    def __init__(self, ranks: str, special: dict[str, int]):
        super().__init__()
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max([*table.values(), *special.values()]) > 0xFFFF:
            raise ValueError("ids of more than 16 bits")
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})._core_bpe
        self.special = {k: pack([v]) for k, v in special.items()}

    def make(self, word: str) -> bytes:
        return pack(self.core.encode_single_piece(word.encode()))

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed; special strings become their own id."""
        get = self.__getitem__
        for special, packed in self.special.items():
            if special in text:
                return packed.join(self.encode(p) for p in text.split(special))
        if len(text) < 400_000:
            return b"".join(map(get, words(text)))
        return b"".join(b"".join(map(get, run)) for run in word_runs(text))


@functools.lru_cache(maxsize=2)
def ids_of(vocabulary: str, ranks: str) -> Ids:
    """The worker's table for a pair of files: the .json names special strings, the other has ranks."""
    with open(vocabulary, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    return Ids(ranks, special)

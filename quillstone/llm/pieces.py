"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from the model file, once a worker:
* the normaliser, which reads a space or the mark U+2581 and writes the mark, and reads one space
  before the text;
* the piece machine, a trie that reads the normaliser's characters and at a piece's end writes its
  id, at the cost of minus its score; characters that are no piece go along byte arcs, one for
  each byte of their UTF-8 form, each at the cost BYTE. Both are composed when they are compiled:
  every arc of the trie that reads the mark has a twin that reads a space;
* the pair machine, whose state is the piece written last: piece b after piece a costs nothing if
  the model's merges, run on the characters of both, end in exactly (a, b), and infinitely much
  otherwise. Its arcs are worked out when they are first met. A sequence of pieces is what the
  merges make of its text if and only if all its neighbours pass.

The machines are composed with each input on the fly: a state is a position and the piece written
last. Positions are relaxed from left to right, each state keeping the least of the sums of costs
that lead to it (the tropical semiring), and the path is read off backwards from the end. No piece
has a mark after another character, nor a line end, so a text is composed segment by segment, and
segments met before are remembered. New segments of a batch of texts are composed together, all of
them advancing by one position at a time in array operations; long ones, and those with characters
that need byte arcs, one by one. Decoding reads ids and writes the pieces' characters.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CACHE_CHARS, Kept
from .shared import slices

MARK = "▁"
_SEGMENT = re.compile(f"\n|[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+")
#: What was written last where anything may follow: nothing yet, or bytes; what a byte arc writes.
_FREE, _BYTES = 1 << 16, -1
#: The cost of a byte arc: more than that of any piece.
BYTE = float(1 << 20)


#: Segments composed together; pairs whose costs a worker keeps.
TOGETHER, PAIRS = 8_000, 1 << 20


class Table:
    """Whole numbers by keys of 64 bits, looked up many at a time; -1 for those not there."""

    def __init__(self, size: int = 1 << 16):
        self.bits = max(4, (size - 1).bit_length())
        self.keys, self.values, self.n = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, at, left = np.full(len(keys), -1, np.int32), self._slots(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            same = there == keys[left]
            out[left[same]] = self.values[at[same]]
            on = ~same & (there >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not there yet; slots are at most half full."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old, new = (self.keys[held], self.values[held]), Table(2 * (self.n + len(keys)))
            new.add(*old)
            self.bits, self.keys, self.values, self.n = new.bits, new.keys, new.values, new.n
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)  # one key for each free slot
            mine = free[first]
            self.keys[slot], self.values[slot] = keys[mine], values[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)


class Pieces:
    """The vocabulary of a model file of the BPE kind with byte fallback and no character map."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, pb.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models without a character map that keep all white space")
        if len(spec.pieces) > 1 << 16 or any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("only models of up to 65,536 pieces, none of them user-defined")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.text = [p.piece for p in spec.pieces]
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("only models whose pieces are made of characters that are pieces")
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("only models without line ends in pieces and with marks only at their beginning")
        self.value = {i: bytes([b]) for b, i in self.byte.items()}
        self.value |= {i: p.encode() for p, i in self.id.items()}
        #: The composed normaliser and trie: a state is [its arcs by character, (piece written there, its cost) or None].
        self.root: list = [{}, None]
        self.longest = max(map(len, self.id), default=1)
        self.compile()
        self.pairs = _Pairs(self)
        self.costs = np.array([-self.score.get(p, 0.0) for p in self.text])
        self.compile_arrays()
        self.segments = _Segments(self)

    def compile(self) -> None:
        for piece, number in self.id.items():
            state = self.root
            for c in piece:
                arcs = state[0]
                if c not in arcs:
                    arcs[c] = [{}, None]
                    if c == MARK:
                        arcs[" "] = arcs[c]
                state = arcs[c]
            state[1] = (number, -self.score[piece])

    def compile_arrays(self) -> None:
        """The same machine as arrays: characters' codes, arcs by (state, code), pieces by state, and pairs met."""
        letters = sorted({c for p in self.id for c in p})
        self.code, self.letters = np.zeros(0x110000, np.int32), len(letters) + 1
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.code[ord(" ")] = self.code[ord(MARK)]
        arcs, writes, open_ = {}, [-1], [(0, self.root[0])]
        while open_:
            number, here = open_.pop()
            for c, (further, written) in here.items():
                if c != " " or MARK not in here:
                    arcs[number * self.letters + int(self.code[ord(c)])] = len(writes)
                    open_.append((len(writes), further))
                    writes.append(-1 if written is None else written[0])
        self.arcs, self.writes, self.met = Table(4 * len(arcs)), np.array(writes, np.int32), Table()
        self.arcs.add(np.array([*arcs], np.int64), np.array([*arcs.values()], np.int32))

    def stands(self, first: str, second: str = "") -> bool:
        """Whether merging the characters of both ends in just these pieces.

        Merging always joins the adjacent pair of best score, leftmost first; it fails as soon as
        it joins characters of both.
        """
        parts, edge, score = list(first + second), len(first), self.score.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if second and at == edge - 1:
                return False
            edge -= at < edge
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == ([first, second] if second else [first])

    def compose(self, text: str) -> bytes:
        """Ids of the shortest path through one segment, as packed 16-bit numbers.

        A piece that ends at a position says where it began, so of the sums that lead to a state,
        one for each state at that beginning, the least is taken at once.
        """
        n, root, pairs, longest, inf = len(text), self.root[0], self.pairs, self.longest, math.inf
        # the states of each position: (least cost, what pairs go by, piece written, beginning, place among its states)
        states: list[list[tuple] | None] = [None] * (n + 1)
        states[0] = [(0.0, _FREE, _BYTES, 0, 0)]
        for i in range(n):
            here = states[i]
            if here is None:
                continue
            one, (cost, last, _, _, _) = len(here) == 1, here[0]
            last <<= 16
            arcs, found = root, False
            for j, c in enumerate(text[i : i + longest], i + 1):
                if c not in arcs:
                    break
                arcs, written = arcs[c]
                if written is None:
                    continue
                found = True
                piece, weight = written
                if one:
                    total, k = cost + pairs[last | piece], 0
                else:
                    total, k = min((state[0] + pairs[state[1] << 16 | piece], k) for k, state in enumerate(here))
                if total < inf:
                    state = (total + weight, piece, piece, i, k)
                    if states[j] is None:
                        states[j] = [state]
                    else:
                        states[j].append(state)
            if not found:  # a character that no piece begins with
                total, k = min((state[0], k) for k, state in enumerate(here))
                states[i + 1] = [*(states[i + 1] or []), (total + BYTE * len(text[i].encode()), _FREE, _BYTES, i, k)]
        out, end = [], n
        _, _, piece, begin, k = min(states[n])
        while end:
            out += (piece,) if piece >= 0 else [self.byte.get(b, self.unknown) for b in reversed(text[begin].encode())]
            end = begin
            _, _, piece, begin, k = states[end][k]
        return array("H", reversed(out)).tobytes()

    def pass_on(self, keys: np.ndarray) -> np.ndarray:
        """Whether the pair machine lets pairs pass, by the keys that `pairs` has."""
        known = self.met.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if self.met.n + len(new) > PAIRS:
                self.met = Table()
                new = np.unique(keys)
            self.met.add(new, np.array([self.pairs.cost(k) < math.inf for k in new.tolist()], np.int32))
            known = self.met.get(keys)
        return known > 0

    def compose_many(self, segments: list[str]) -> list[bytes]:
        """`compose` for many segments of characters that are pieces, advancing together."""
        lengths = np.array([*map(len, segments)])
        ends = np.cumsum(lengths)
        code = self.code[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        ends_of = np.repeat(ends, lengths)
        # paths through the trie from every position: where they begin, their lengths and pieces
        begin, node, depth, found = np.arange(len(code)), np.zeros(len(code), np.int64), 0, []
        while len(begin):
            inside = begin + depth < ends_of[begin]
            begin, node = begin[inside], node[inside]
            node = self.arcs.get(node * self.letters + code[begin + depth]).astype(np.int64)
            begin, node, depth = begin[node >= 0], node[node >= 0], depth + 1
            written = self.writes[node]
            found.append((begin[written >= 0], np.full(int((written >= 0).sum()), depth), written[written >= 0]))
        begin, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(begin, kind="stable")
        length, piece = length[order].astype(np.int64), piece[order].astype(np.int64)
        count = np.bincount(begin, minlength=len(code))
        first = np.cumsum(count) - count
        # states: position, piece written last, least cost, state before; those at each place in their segments
        position, last, cost, before = (ends - lengths).astype(np.int64), np.full(len(segments), _FREE), np.zeros(len(segments)), np.full(len(segments), -1)
        segment, made = np.arange(len(segments)), len(segments)
        states, waiting, done = [(position, last, cost, before, segment)], {0: [(position, last, cost, np.arange(made), segment)]}, []
        for t in range(int(lengths.max(initial=0))):
            if t not in waiting:
                continue
            position, last, cost, number, segment = (np.concatenate(x) for x in zip(*waiting.pop(t), strict=True))
            n = count[position]
            source = np.repeat(np.arange(len(position)), n)
            arc = np.repeat(first[position] - (np.cumsum(n) - n), n) + np.arange(len(source))
            passing = self.pass_on(last[source] << 16 | piece[arc])
            source, arc = source[passing], arc[passing]
            total = cost[source] + self.costs[piece[arc]]
            if len(arc) > 1:  # the least sum of those that lead to one state
                order = np.lexsort((total, arc))
                order = order[np.concatenate([[True], arc[order][1:] != arc[order][:-1]])]
                source, arc, total = source[order], arc[order], total[order]
            new = (position[source] + length[arc], piece[arc], total, number[source], segment[source])
            states.append(new)
            numbers = made + np.arange(len(arc))
            made += len(arc)
            at_end = new[0] == ends[new[4]]
            done.append((new[4][at_end], total[at_end], numbers[at_end]))
            for k in np.unique(length[arc[~at_end]]).tolist():
                own = (length[arc] == k) & ~at_end
                waiting.setdefault(t + k, []).append((new[0][own], new[1][own], total[own], numbers[own], new[4][own]))
        _, last, _, before, _ = (np.concatenate(x) for x in zip(*states, strict=True))
        owner, total, number = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((total, owner))
        order = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        owner, number = owner[order], number[order]
        path = []  # backwards from the ends
        while len(number):
            path.append((owner, last[number]))
            owner, number = owner[before[number] >= len(segments)], before[number][before[number] >= len(segments)]
        owner = np.concatenate([o for o, _ in path])
        back = np.repeat(np.arange(len(path)), [len(o) for o, _ in path])
        order = np.lexsort((-back, owner))
        ids = np.concatenate([x for _, x in path])[order].astype(np.uint16).tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(segments))) * 2]).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, as the library gives them without begin and end marks."""
        found = [_SEGMENT.findall(self.prefix + t) if t else [] for t in texts]
        known, older = self.segments, self.segments.older
        new = [x for x in {x for f in found for x in f} if len(x) <= CACHE_CHARS and x not in known and x not in older]
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            whole = self.code[np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)] > 0
            sizes = np.array([*map(len, part)])
            whole = np.logical_and.reduceat(whole, np.cumsum(sizes) - sizes)
            part = [x for x, ok in zip(part, whole.tolist(), strict=True) if ok]
            for x, ids in zip(part, self.compose_many(part), strict=True) if part else ():
                known.keep(x, ids)
        return [np.frombuffer(b"".join(map(known.__getitem__, f)), np.uint16) for f in found]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, ids without text nothing."""
        value = self.value.get
        text = b"".join([value(i, b"") for i in ids]).decode(errors="replace").replace(MARK, " ")
        return text.removeprefix(" ") if self.prefix else text


class _Pairs(Kept):
    """The cost of piece b after piece a, by (a << 16 | b); with _FREE for a, that of b where nothing bears on it."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, key: int) -> float:
        value = self.older.get(key)
        return self.keep(key, self.cost(key) if value is None else value)

    def cost(self, key: int) -> float:
        both = (key & 0xFFFF,) if key >> 16 == _FREE else (key >> 16, key & 0xFFFF)
        return 0.0 if self.pieces.stands(*(self.pieces.text[p] for p in both)) else math.inf


class _Segments(Kept):
    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def make(self, segment: str) -> bytes:
        return self.pieces.compose(segment)


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    machine = pieces_of(model)
    for b in slices(batches):
        texts = b.column(1).to_pylist()
        encoded = machine.encode_all([t or "" for t in texts])
        ids = [None if t is None else x.astype("<u4").tobytes() for t, x in zip(texts, encoded, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    machine = pieces_of(model)
    for b in slices(batches, "ids"):
        texts = [None if x is None else machine.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "decoded"])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, text and ids (unsigned little-endian 32-bit numbers).

    A null text has null ids, an empty one none. A null doc_id stays null; repeated rows each keep
    their row; an empty table gives no rows; other columns are not read. Texts go through whole.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, model), "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of `encoded` (doc_id, text, ids) with a column `decoded`.

    Null ids decode to null, none to an empty text; ids without text and bytes that are no UTF-8
    are handled as in `Pieces.decode`. Repeated rows each keep their row, an empty table gives no
    rows, and further columns are not read.
    """
    return encoded.select("doc_id", "text", "ids").mapInArrow(lambda batches: _decoded(batches, model), "doc_id long, text string, ids binary, decoded string")


def both_ways(docs: DataFrame, model: str) -> DataFrame:
    """The rows of `decode(encode(docs, model), model)`, by one Python worker a task.

    One after the other, the two passes take two workers a task, each with its own machine and
    whatever segments it has met.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _decoded(_encoded(batches, model), model), "doc_id long, text string, ids binary, decoded string"
    )

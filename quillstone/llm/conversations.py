"""Repair of conversations: the cheapest edits after which roles take turns, by composed weighted machines.

Three machines are composed, state by state as they are met:

* the input acceptor, a chain of one symbol for each row: its role's initial and its fault;
* the edit transducer: a row is kept, given another role or deleted, an empty row is inserted; each
  arc has a label and a cost;
* the grammar, an acceptor of role initials: nothing, or `s?(ua)+`.

Weights are pairs (cost, labels), compared in this order. The chain gives a topological order, so the
shortest path is found in one walk from the last row back. Labels are never built on the way: for
each state it is enough to know the cost and the place of its labels among those of the other
states, since all go on with at most two insertions and the label of one row. The few such columns
that occur are remembered, which makes the walk one lookup a row.

A conversation of usual length is repaired in one go. The rows of a long one are dealt over tasks by
ranges; each task turns blocks of them into small tables of (cost, place) from any state to any
other, these are joined to the path of the whole, and the blocks are labelled again, each for
itself. Only the digest of a whole conversation reads its rows one after the other, as they come,
and holds a byte for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import few
from .shared import dealt_join, staged

#: Rows, and bytes of text, of a conversation that is repaired in one go; rows of a block of a longer one.
LONG, HELD, BLOCK = 4096, 16 << 20, 4096
#: The grammar: next state for each role initial; final states.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits; that of a row which stays though its text breaks off.
RENAME, DELETE, INSERT, BROKEN = 3, 4, 3, 3
#: Faults of rows.
SOUND, BLANK, AGAIN, CUT = range(4)
INITIALS = "sua?"
SPACE = " \t\n\x0b\x0c\r"

#: For every state, (cost, place) of the best labels from there on; None where no path goes on.
Ends = tuple


def symbol(initial: str, fault: int) -> int:
    """A row as the input acceptor has it; of a row that must go the initial does not matter."""
    known = initial and initial in INITIALS and fault not in (BLANK, AGAIN)
    return 4 * fault + (INITIALS.index(initial) if known else 3)


def edits(s: int) -> Iterator[tuple[str, str, int]]:
    """Arcs of the edit transducer that read the symbol: label, what is written, cost."""
    fault, initial = divmod(s, 4)
    if fault not in (BLANK, AGAIN):
        more = BROKEN if fault == CUT else 0
        yield "K", INITIALS[initial], more
        for role in ROLES:
            yield "R", role, RENAME + more
    yield "D", "", DELETE


def renamed(state: int) -> str:
    """The role that can be inserted in a state, or given to a row."""
    return next(r for r in GRAMMAR[state] if r in ROLES)


def insertions(state: int) -> list[int]:
    """The states that up to two insertions lead to; more come back to one of them."""
    reached = [state]
    for _ in range(2):
        reached.append(GRAMMAR[reached[-1]][renamed(reached[-1])])
    return reached


def _ranked(best: list[list[tuple | None]]) -> tuple[Ends, ...]:
    order = {k: i for i, k in enumerate(sorted({x[1:3] for col in best for x in col if x}))}
    return tuple(tuple(x and (x[0], order[x[1:3]]) for x in col) for col in best)


def ending() -> Ends:
    """The column after the last row: insertions up to a final state."""
    best = [min((INSERT * j, "I" * j, 0) for j, t in enumerate(insertions(q)) if t in FINAL) for q in range(len(GRAMMAR))]
    return _ranked([best])[0]


def tail(state: int) -> str:
    return min((INSERT * j, "I" * j) for j, t in enumerate(insertions(state)) if t in FINAL)[1]


class Walk:
    """Steps from a row's right side to its left one; columns for several ends go together, so that their labels can be compared."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        self.arcs: dict[tuple[int, int], list[tuple[str, int, int]]] = {}

    def composed(self, s: int, state: int) -> list[tuple[str, int, int]]:
        """(labels, next state, cost) of all ways to read the symbol from a state, insertions before it included."""
        if (s, state) not in self.arcs:
            found = []
            for j, q in enumerate(insertions(state)):
                for label, role, cost in edits(s):
                    if not role or role in GRAMMAR[q]:
                        found.append(("I" * j + label, GRAMMAR[q][role] if role else q, INSERT * j + cost))
            self.arcs[s, state] = found
        return self.arcs[s, state]

    def step(self, s: int, columns: tuple[Ends, ...]) -> tuple[tuple[int, ...], tuple[Ends, ...], tuple]:
        """What each column has grown by, the columns on the left (the least cost of each is 0), and (labels, next state) chosen there."""
        key = s, columns
        if key not in self.known:
            best = []
            for col in columns:
                ways = [[(cost + col[t][0], labels, col[t][1], t) for labels, t, cost in self.composed(s, q) if col[t]] for q in range(len(GRAMMAR))]
                best.append([min(w) if w else None for w in ways])
            ranked = _ranked(best)
            grown = tuple(min((x[0] for x in col if x), default=0) for col in ranked)
            left = tuple(tuple(x and (x[0] - g, x[1]) for x in col) for g, col in zip(grown, ranked, strict=True))
            self.known[key] = grown, left, tuple(tuple(x and (x[1], x[3]) for x in col) for col in best)
        return self.known[key]

    def labels(self, symbols: bytes, start: int, after: Ends) -> tuple[int, str, int]:
        """Cost, labels and last state of the best path over the symbols."""
        columns, chosen, total = (after,), [], 0
        for s in reversed(symbols):
            (grown,), columns, choices = self.step(s, columns)
            total += grown
            chosen.append(choices[0])
        out, state = [], start
        for choice in reversed(chosen):
            labels, state = choice[state]
            out.append(labels)
        return total + columns[0][start][0], "".join(out), state

    def summary(self, symbols: bytes) -> tuple[list[int | None], list[int | None]]:
        """Costs and places of the best labels from every state to every state, start by start."""
        n = len(GRAMMAR)
        columns = tuple(tuple((0, 0) if q == e else None for q in range(n)) for e in range(n))
        totals = [0] * n
        for s in reversed(symbols):
            grown, columns, _ = self.step(s, columns)
            totals = [a + b for a, b in zip(totals, grown, strict=True)]
        cells = [(columns[e][q], totals[e]) for q in range(n) for e in range(n)]
        return [x and x[0] + t for x, t in cells], [x and x[1] for x, _ in cells]


class Rows:
    """Rows of one conversation in order: their symbols, and what is counted on the way."""

    def __init__(self):
        self.symbols, self.kept = bytearray(), []
        self.counts = [0] * 4
        self.illegal = self.turns = 0
        self.first = self.last = None  # initials at both ends
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.symbols.append(symbol(initial, fault))

    def then(self, other: Rows) -> None:
        """The counts of rows that follow."""
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        self.illegal += other.illegal
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high

    def facts(self) -> tuple[int, int, int, int, int]:
        """gaps, blank, duplicate, truncated, illegal."""
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.counts[BLANK], self.counts[AGAIN], self.counts[CUT], self.illegal


def messages(labels: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired conversation: (role, text) of what the labels leave and insert."""
    at, state = 0, 0

    def inserted():
        nonlocal at, state
        while at < len(labels) and labels[at] == "I":
            role = renamed(state)
            yield ROLES[role], ""
            at, state = at + 1, GRAMMAR[state][role]

    for role, text in rows:
        yield from inserted()
        label, at = labels[at], at + 1
        if label == "K":
            yield role, text
            state = GRAMMAR[state][role[:1]]
        elif label == "R":
            given = renamed(state)
            yield ROLES[given], text
            state = GRAMMAR[state][given]
    yield from inserted()


def digest(found: Iterable[tuple[str, str]]) -> str:
    """sha256 of the `role:text` of all messages, joined by newlines."""
    total, between = hashlib.sha256(), b""
    for role, text in found:
        total.update(between + role.encode() + b":" + text.encode())
        between = b"\n"
    return total.hexdigest()


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with faults that crc32 of `conv_id:turn` plants, and the condition of those that are gone.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it and 4
    makes it the user's. A null counts as one space.
    """
    blank = F.lit(" ")
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    out = rows.select(
        "conv_id", "turn", F.when(key == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(key == 1, F.lit("")).when(key == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (key == 0).alias("gone"), F.explode(F.when(key == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out, F.col("gone")


PREPARED = ["c", "conv_id", "turn", "role", "text", "key", "fault", "copies", "live", "kind"]


def prepared(rows: DataFrame, gone: Column) -> DataFrame:
    """One staged row for each different row of a conversation, with its number and fault; before one that was seen at another turn, a row of kind 0."""
    text = F.coalesce("text", F.lit(" "))
    base = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"), "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(~gone, F.coalesce("role", F.lit(" "))).alias("role"), F.when(~gone, text).alias("text"), (~gone).alias("live"),
    )
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", F.lit(BLANK)).when(~last.isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(SOUND))
    one = base.groupBy(*base.columns).count().withColumnRenamed("count", "copies")
    one = staged(one.select("*", F.md5("text").alias("key"), fault.cast("int").alias("fault"), F.lit(1).alias("kind")).select(*PREPARED))
    words = one.where(F.col("live") & (F.col("fault") != BLANK)).select("c", "turn", "role", "key")
    often = words.groupBy("c", "role", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = dealt_join(words, staged(often), ["c", "role", "key"], F.col("turn")).where(~F.col("turn").eqNullSafe(F.col("first.turn")))
    none = {x: F.lit(None).cast(one.schema[x].dataType).alias(x) for x in PREPARED}
    again = again.select(*(x if x in ("c", "turn", "role", "key") else F.lit(True).alias(x) if x == "live" else F.lit(0).alias(x) if x == "kind" else none[x] for x in PREPARED))
    return one.unionByName(staged(again))


def _order() -> list[Column]:
    return [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("kind")]


def _read(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("c", "conv_id", "turn", "role", "text", "key", "fault", "copies", "live", "kind")) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in columns), strict=True)


def _faults(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(c, conv_id, turn, role, text, fault) of every row, repeated ones each; role is None for one that is gone."""
    again = None
    for c, conv_id, turn, role, text, key, fault, copies, live, kind in rows:
        if kind == 0:
            again = c, turn, role, key
        elif not live:
            yield c, conv_id, None, None, None, SOUND
        else:
            for i in range(copies):
                yield c, conv_id, turn, role, text, fault if fault == BLANK or not i and again != (c, turn, role, key) else AGAIN


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
DIGEST = f"conv_id {{id}}, {FACTS}, repaired_sha256 string"
MESSAGES = "conv_id {id}, place long, role string, text string"


def _emitted(whole: bool, fields: str, found: Iterator[tuple[object, tuple, Iterator[tuple[str, str]]]]) -> Iterator[pa.RecordBatch]:
    """Batches of digests, or of the messages themselves, for (conv_id, facts, messages)."""
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[t]) for n, t in (f.split() for f in fields.split(", "))])
    rows: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for conv_id, facts, texts in found:
        if whole:
            for place, (role, text) in enumerate(texts):
                rows.append((conv_id, place, role, text))
                held += len(text)
                if len(rows) >= 2048 or held > 4 << 20:
                    yield made()
                    rows, held = [], 0
        else:
            rows.append((conv_id, *facts, digest(texts)))
            if len(rows) >= 2048:
                yield made()
                rows = []
    if rows:
        yield made()


def _short(rows: DataFrame, whole: bool, fields: str) -> DataFrame:
    def conversations(batches):
        walk, end = Walk(), ending()

        def ended(conv_id, own: Rows):
            cost, labels, state = walk.labels(bytes(own.symbols), 0, end)
            labels += tail(state)
            return conv_id, (*own.facts(), cost, labels), messages(labels, own.kept)

        own, at, known = Rows(), None, None
        for c, conv_id, turn, role, text, fault in _faults(_read(batches)):
            if at is not None and c != at:
                yield ended(known, own)
                own = Rows()
            at, known = c, conv_id
            if role is not None:
                own.add(turn, role[:1], fault)
                own.kept.append((role, text))
        if at is not None:
            yield ended(known, own)

    return rows.repartition("c").sortWithinPartitions(*_order()).mapInArrow(lambda batches: _emitted(whole, fields, conversations(batches)), fields)


BLOCKS = "c string, part int, seq int, symbols binary, costs array<long>, places array<int>, counts array<long>, illegal long, turns long, low long, high long, first string, last string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that follow each other, with the best ways through them from any state to any other."""
    walk, part, seq = Walk(), TaskContext.get().partitionId(), 0

    def made(c, own):
        nonlocal seq
        seq += 1
        costs, places = walk.summary(bytes(own.symbols))
        row = c, part, seq, bytes(own.symbols), costs, places, own.counts, own.illegal, own.turns, own.low, own.high, own.first, own.last
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    text, long, small = pa.string(), pa.int64(), pa.int32()
    kinds = [text, small, small, pa.binary(), pa.list_(long), pa.list_(small), pa.list_(long), long, long, long, long, text, text]
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    own, at = Rows(), None
    for c, _, turn, role, _, fault in _faults(_read(batches)):
        if at is not None and (c != at or len(own.symbols) >= BLOCK):
            yield made(at, own)
            own = Rows()
        at = c
        own.add(turn, role[:1], fault)
    if at is not None:
        yield made(at, own)


WAYS = "c string, part int, seq int, begin int, final int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _ways(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation the states at both its ends, on the best path of the whole; and what is counted."""
    blocks = blocks.sort_values(["part", "seq"])
    n, after, chosen = len(GRAMMAR), ending(), []
    for costs, places in zip(reversed(blocks["costs"].tolist()), reversed(blocks["places"].tolist()), strict=True):
        best = []
        for q in range(n):
            ways = []
            for e in range(n):
                cost, place = costs[n * q + e], places[n * q + e]
                if cost is not None and cost == cost and after[e]:  # pandas turns None into nan
                    ways.append((int(cost) + after[e][0], int(place), after[e][1], e))
            best.append(min(ways) if ways else None)
        chosen.append([x and x[3] for x in best])
        (after,) = _ranked([best])
    total = Rows()
    for row in blocks.itertuples():
        own = Rows()
        own.counts, own.illegal, own.turns, own.first, own.last = [int(x) for x in row.counts], int(row.illegal), int(row.turns), row.first, row.last
        own.low, own.high = (None if pd.isna(x) else int(x) for x in (row.low, row.high))
        total.then(own)
    out, state = [], 0
    for part, seq, choice in zip(blocks["part"], blocks["seq"], reversed(chosen), strict=True):
        out.append([blocks["c"].iloc[0], part, seq, state, choice[state], "", *total.facts(), after[0][0]])
        state = choice[state]
    out[-1][5] = tail(state)
    return pd.DataFrame(out, columns=[f.split()[0] for f in WAYS.split(", ")])


def _labelled(blocks: DataFrame) -> DataFrame:
    """(c, gaps ... cost, audit) of the conversations whose blocks these are."""

    def run(batches):
        walk = Walk()
        for b in batches:
            found = []
            for symbols, begin, final, more in _read([b], ("symbols", "begin", "final", "tail")):
                end = tuple((0, 0) if q == final else None for q in range(len(GRAMMAR)))
                found.append(walk.labels(symbols, begin, end)[1] + more)
            kept = [b.column(b.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*names, "labels"])

    names = ["c", "part", "seq", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ways = staged(blocks.drop("symbols").groupBy("c").applyInPandas(_ways, WAYS))
    rows = blocks.select("c", "part", "seq", "symbols").join(ways, ["c", "part", "seq"])
    rows = rows.mapInArrow(run, ", ".join(f"{x} {'string' if x == 'c' else 'int' if x in ('part', 'seq') else 'long'}" for x in names) + ", labels string")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "labels"))), lambda x: x["labels"]), "")
    return rows.groupBy("c", *names[3:]).agg(whole.alias("audit"))


def _long(rows: DataFrame, whole: bool, fields: str) -> DataFrame:
    dealt = rows.where("live").drop("text").withColumn("text", F.lit("")).repartitionByRange(*_order()).sortWithinPartitions(*_order())
    found = staged(_labelled(staged(dealt.mapInArrow(_blocks, BLOCKS))))

    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    head = found.select("c", *names, F.lit(0).alias("head"))
    both = rows.where("live").withColumn("head", F.lit(1)).unionByName(head, allowMissingColumns=True)

    def conversations(batches):
        """Rows are read as they come: a conversation's facts, then its rows, one after the other."""
        stream = _read(batches, (*PREPARED, "head", *names))
        ahead = next(stream, None)
        while ahead is not None:
            assert ahead[10] == 0, "a long conversation begins with its facts"
            c, facts = ahead[0], ahead[11:]
            ahead = next(stream, None)

            def own(c=c):
                nonlocal ahead
                while ahead is not None and ahead[0] == c:
                    yield ahead[:10]
                    ahead = next(stream, None)

            conv_id = ahead[1] if ahead[9] else None
            rest = own()
            if not ahead[9]:  # a mark comes first; the row that it marks knows the id
                mark = next(rest)
                conv_id = ahead[1]
                rest = _chained(mark, rest)
            texts = messages(facts[-1], ((role, text) for _, _, _, role, text, _ in _faults(rest)))
            yield conv_id, facts, texts
            for _ in texts:  # whatever the reader left
                pass

    order = [F.col("c"), F.col("head"), *_order()[1:]]
    return both.repartition("c").sortWithinPartitions(*order).mapInArrow(lambda batches: _emitted(whole, fields, conversations(batches)), fields)


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def _repaired(rows: DataFrame, gone: Column | None, whole: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = (MESSAGES if whole else DIGEST).format(id={"bigint": "long"}.get(kind, kind))
    found = prepared(rows, F.lit(False) if gone is None else gone)
    sizes = found.where("live and kind = 1").groupBy("c").agg(F.sum("copies").alias("rows"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    long = staged(sizes.where((F.col("rows") > LONG) | (F.col("bytes") > HELD)).select("c"))
    if long.isEmpty():
        return _short(found, whole, fields)
    long = few(long)
    return _short(found.join(long, "c", "left_anti"), whole, fields).unionByName(_long(found.join(long, "c", "left_semi").select(*PREPARED), whole, fields))


def repaired(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text. `audited` says how nulls, ties and repeated rows are taken."""
    return _repaired(rows, gone, True)


def audited(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows ascend by turn, nulls first; those of one turn by role and then by the md5 of their text,
    so that repeated rows are neighbours. A null role or text counts as one space, which is blank
    in a text and no role of the grammar; rows of a null conv_id are one conversation. Rows where
    `gone` holds count for nothing, but their conversation has a result: one without rows has
    zeros, an empty audit and the digest of an empty text. Other columns are not read; an empty
    table gives no rows.
    """
    return _repaired(rows, gone, False)

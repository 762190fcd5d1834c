"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import conversations

WORD = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hurt(rows):
    """conv_id -> rows (turn, role, text) after the damage, in order."""
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(own, key=order) for c, own in found.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(symbols):
    """Least (cost, labels) for (initial, fault) symbols, by trying every edit everywhere."""

    @lru_cache(None)
    def best(i, last, spare):
        ways = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        if spare:
            ways += [(3 + c, "I" + s) for x in "ua" if (last, x) in NEXT for c, s in [best(i, x, spare - 1)]]
        if i < len(symbols):
            initial, fault = symbols[i]
            ways += [(4 + c, "D" + s) for c, s in [best(i + 1, last, 3)]]
            if fault not in ("blank", "duplicate"):
                for label, cost, x in [("K", 0, initial), ("R", 3, "u"), ("R", 3, "a")]:
                    if (last, x) in NEXT:
                        ways += [(cost + 3 * (fault == "truncated") + c, label + s) for c, s in [best(i + 1, x, 3)]]
        return min(ways) if ways else (10**9, "")

    return best(0, "", 3)


def brute(rows):
    out = []
    for conv, own in hurt(rows).items():
        found = faults(own)
        cost, audit = cheapest(tuple((role[:1], f) for (_, role, _), f in zip(own, found, strict=True)))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        texts, last, rest = [], "", iter(own)
        for label in audit:
            row = None if label == "I" else next(rest)
            if label == "D":
                continue
            letter = row[1][:1] if label == "K" else "a" if last == "u" else "u"
            texts.append(f"{row[1] if label == 'K' else NAMES[letter]}:{row[2] if row else ''}")
            last = letter
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in texts))
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(texts))))
    return sorted(out, key=str)


def run(spark, rows, how="audited"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, kind int")
    return sorted((tuple(r) for r in getattr(conversations, how)(*conversations.damaged(df)).collect()), key=str)


def corpus(seed, n, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, most)):
            turn = rng.choice([turn, turn, turn, None, turn + 3, -turn])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "Übung"])
            rows.append((conv, turn, role, rng.choice([None, "", " \t", "Well.", "Why?\n", "broken off", "so", "é.", "a.b", "end. "])))
    rng.shuffle(rows)
    return rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["", "blank", "truncated", "duplicate"])), max_size=9), st.integers(0, 9), st.integers(0, 9))
def test_walk_and_blocks(symbols, cut, more):
    """The walk over symbols, in one go and joined from blocks, gives the least cost and labels."""
    codes = [conversations.SOUND, conversations.BLANK, conversations.CUT, conversations.AGAIN]
    codes = bytes(conversations.symbol(i, codes[["", "blank", "truncated", "duplicate"].index(f)]) for i, f in symbols)
    walk, end = conversations.Walk(), conversations.ending()
    cost, labels, state = walk.labels(codes, 0, end)
    assert (cost, labels + conversations.tail(state)) == cheapest(tuple(symbols))
    import pandas as pd

    parts = [x for x in (codes[:cut], codes[cut : cut + more], codes[cut + more :]) if x]
    if parts:
        rows = [("c", 0, i, *walk.summary(x), [0] * 4, 0, 0, None, None, "u", "u") for i, x in enumerate(parts)]
        ways = conversations._ways(pd.DataFrame(rows, columns="c part seq costs places counts illegal turns low high first last".split()))
        text = "".join(walk.labels(x, w.begin, tuple((0, 0) if q == w.final else None for q in range(4)))[1] + w.tail for x, w in zip(parts, ways.itertuples(), strict=True))
        assert (ways["cost"][0], text) == cheapest(tuple(symbols))


def test_equals_search(spark):
    rows = corpus(1, 300)
    assert run(spark, rows) == brute(rows)


def test_long_conversations(spark, monkeypatch):
    """Conversations in blocks over several tasks give what they give in one go, repeated rows and copies included."""
    rows = corpus(2, 25, 60) + [(3, 5, "user", "Again.")] * 40 + [(4, t, "assistant", "The same.") for t in range(90)]
    want = run(spark, rows), run(spark, rows, "repaired")
    assert want[0] == brute(rows)
    for name, value in (("LONG", 12), ("BLOCK", 5)):
        monkeypatch.setattr(conversations, name, value)
    assert (run(spark, rows), run(spark, rows, "repaired")) == want


def test_repaired_rows(spark):
    """The digest is that of the repaired rows."""
    rows = corpus(3, 60)
    found = {}
    for conv, place, role, text in run(spark, rows, "repaired"):
        found.setdefault(conv, []).append((place, f"{role}:{text}"))
    whole = {r[0]: r[-1] for r in run(spark, rows)}
    assert {c: sha("\n".join(t for _, t in sorted(found.get(c, [])))) for c in whole} == whole
    assert all([p for p, _ in sorted(x)] == [*range(len(x))] for x in found.values())


@pytest.mark.parametrize("rows", [[], [(7, t, "user", "Gone.") for t in range(400) if zlib.crc32(f"7:{t}".encode()) % 20 == 0], [(1, 2, "user", "x" * 200_000 + "."), (1, None, None, None), (None, None, None, None)]])
def test_edges(spark, rows):
    got = run(spark, rows)
    assert got == brute(rows)
    if rows and rows[0][0] == 7:
        assert got == [(7, 0, 0, 0, 0, 0, 0, "", sha(""))]

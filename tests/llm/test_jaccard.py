"""The Jaccard join against brute force over all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import jaccard, shared


def plain_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in words.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=75):
    """(doc_id, n, component) by comparing every two rows."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, node string")
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randrange(40))
    text = lambda k: [word() for _ in range(k)]
    passages = [text(60), text(20), text(12)]
    texts = []
    while len(texts) < n:
        base = text(rng.choice([0, 1, 3, 4, 5, 8, 30, 60, 120]))
        if rng.random() < 0.4:  # a passage that many documents share
            at = rng.randrange(len(base) + 1)
            base[at:at] = rng.choice(passages)
        for _ in range(rng.choice([1, 1, 1, 2, 3, 25])):  # a group of copies with up to some edits
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if copy:
                    copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += text(rng.randrange(12))
            texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(w.upper() if rng.random() < 0.1 else w for w in copy))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts[:n], strict=True))


def test_equals_brute_force(spark):
    rows = corpus(1, 420)
    rows += [(-1, None), (-2, ""), (-3, " \n\t "), (None, rows[5][1]), (None, "alone here with nobody else at all"), rows[7], (rows[8][0], "another text under an id that is taken already"), (-9, "É é É é É"), (-10, "é é é é é")]
    assert run(spark, rows) == brute(rows)


def test_small_groups_and_blocks(spark, monkeypatch):
    """The same when the matrix has many groups and tasks send many blocks."""
    for name, value in (("GROUP", 3), ("QUERIES", 4), ("BATCH", 500), ("BROADCAST", 0)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(shared, "FAIR", 2)
    # without pivots all links have to come from the matrix
    monkeypatch.setattr(jaccard, "verified", lambda pairs, stored, percent: pairs.limit(0))
    rows = corpus(2, 200)
    assert run(spark, rows) == brute(rows)


def test_frequent_keys_are_dealt(spark, monkeypatch):
    """A hot set and a hot pivot, when a task's share of a key is a few rows; texts that meet in 48 bits."""
    monkeypatch.setattr(shared, "FAIR", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(0, 120, 2)]
    for i in range(1, 120, 2):
        copy = list(base)
        copy[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, f"p{i} q{i} r{i} s{i} t{i}") for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_dealt_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "FAIR", 3)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(60)] + [(None, 61), (99, 62)], "k long, v long")
    table = spark.createDataFrame([(k, str(k)) for k in range(6)], "k long, name string")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, rows.join(table, "k", how).collect()), key=str)
        assert sorted(map(tuple, shared.dealt_join(rows, table, "k", rows.v, how).collect()), key=str) == want


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(150_000))
    rows = [(1, long), (2, long + " one more"), (3, long[: len(long) // 2]), (4, "short text of six words here")]
    assert run(spark, rows) == brute(rows)


def test_shingles_that_meet_in_the_sent_bits(spark, monkeypatch):
    """Sent bits are cut to very few, so that many shingles of a set meet; no link is lost."""
    plain = jaccard.shingles
    monkeypatch.setattr(jaccard, "shingles", lambda *a: np.unique(plain(*a) >> np.uint64(44) << np.uint64(44) | plain(*a) & np.uint64(0xFFFF)))
    docs = spark.createDataFrame([(i, t) for i, t in corpus(7, 120)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    sets = {r.doc_id: jaccard.shingles(r.text or "", jaccard._Hashes(), 5) for r in docs.collect()}
    for a, x in sets.items():
        assert got[a][0] == len(x)
        for b, y in sets.items():
            if len(x) and len(y) and jaccard.similar(x, y, 75):
                assert got[a][1] == got[b][1]


def test_nothing_alike_and_empty(spark):
    assert run(spark, [(1, "a b c d e f g"), (2, "h i j k l m")]) == [(1, 3, 1), (2, 2, 2)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0
    assert jaccard.one_of_each(df).count() == 0


def test_chain_of_labels(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**9), 60)
    pairs = list(zip(ids[:40], ids[1:40])) + list(zip(ids[41:], ids[42:]))
    links = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(links).collect()}
    assert set(got) == set(ids[:40]) | set(ids[41:])
    assert len({got[i] for i in ids[:40]}) == 1 and len({got[i] for i in ids[41:]}) == 1 and got[ids[0]] != got[ids[50]]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)))
def test_similar(a, b):
    got = jaccard.similar(np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64), 75) if a and b else False
    assert got == bool(a and b and 100 * len(a & b) >= 75 * len(a | b))


@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(0, 2**32 - 1)))
def test_squeeze_round_trip(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint32)
    p, q = jaccard.unsqueeze(jaccard.squeeze(x, y))
    assert (p == x).all() and (q == y).all()


@pytest.mark.parametrize("n", range(1, 60))
def test_needed(n):
    assert jaccard.needed(np.array([n]), 75)[0] == min(k for k in range(n + 1) if 100 * k >= 75 * n)

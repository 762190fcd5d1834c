"""Circulant MinHash against brute force over all pairs."""

import random

import numpy as np
import pytest

from quillstone.llm import minhash

from .test_jaccard import brute, corpus


def run(spark, table, **more):
    df = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in table], "doc_id long, text string, n long, node string, bands string")
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **more).collect()), key=str)


def wanted(rows):
    return [(*r, r[0] == r[2]) for r in brute(rows, 85)]


def test_permutations_are_one_to_one():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 300_000, dtype=np.uint32))
    for by in (minhash.SCATTER, minhash.ORDER):
        assert len(np.unique(minhash.permuted(x.copy(), by, np.empty_like(x)))) == len(x)


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.85, 0.95])
def test_coordinates_agree_as_often_as_sets_overlap(similarity):
    """The share of equal coordinates is an unbiased estimate, with no more spread than independent permutations have."""
    rng, errors = np.random.default_rng(2), []
    for _ in range(150):
        n = 400
        both = round(2 * n * similarity / (1 + similarity))
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) << np.uint64(1)
        a, b = minhash.signatures([x[:n], np.concatenate([x[:both], x[n:]])])
        errors.append((a == b).mean() - both / (2 * n - both))
    spread = (similarity * (1 - similarity) / (minhash.BANDS * minhash.ROWS)) ** 0.5
    assert abs(np.mean(errors)) < 4 * spread / len(errors) ** 0.5
    assert np.std(errors) < 1.25 * spread


def test_long_sets_are_cut_without_a_trace(monkeypatch):
    sets = [np.random.default_rng(i).integers(0, 1 << 63, n, dtype=np.uint64) for i, n in enumerate([1, 700, 3, 40, 1000, 2])]
    whole = minhash.signatures(sets)
    monkeypatch.setattr(minhash, "PIECE", 64)
    assert (minhash.signatures(sets) == whole).all()
    assert (np.vstack([minhash.signatures([s]) for s in sets]) == whole).all()


@pytest.mark.parametrize("seed,n", [(1, 150), (2, 300)])
def test_equals_all_pairs(spark, seed, n):
    rows = corpus(seed, n)
    assert run(spark, rows) == wanted(rows)


def test_crowded_buckets(spark):
    """Many documents that share most of a passage, and links between some of them only."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(120)]
    rows = []
    for i in range(120):
        own = [word() for _ in range(rng.choice([20, 30, 45]))]
        rows.append((i, " ".join(passage + own)))
        if i % 3 == 0:  # a near copy
            rows.append((1000 + i, " ".join(passage + own[:-1] + ["end"])))
    rng.shuffle(rows)
    assert run(spark, rows) == wanted(rows)
    # coarse bands put nearly all of them into each bucket; the result is the same
    assert run(spark, rows, bands=24, rows=1) == wanted(rows)


def test_edges(spark):
    assert run(spark, []) == []
    long = " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c d e f"), (None, "a b"), (8, long), (9, long + " end"), (9, long + " end"), (None, None), (10, "é É"), (11, "É É")]
    assert run(spark, rows) == [(d, n, c, d == c) for d, n, c in brute(rows, 85)]

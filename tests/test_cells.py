"""The index of cells against a comparison with every exemplar, and the number of cells opened."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import cells, vectors

BANK = "exemplar_idx long, label string, text string, embedding array<double>"


def clustered(n: int, seed: int):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 8))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    return middles[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * 0.05


def flat(x, bank, k):
    return [i for _, i in sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in bank)[:k]]


@pytest.mark.parametrize(("block", "turn"), [(1024, 65_536), (7, 5)])
def test_equal_to_the_flat_result(spark, monkeypatch, block, turn):
    """Ties by repeated vectors, unusable vectors, blocks and turns of hot cells, and few cells opened."""
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "TURN", turn)
    made = clustered(600, 1).tolist()
    made += made[:40]  # ties
    bank = [(i, f"l{i % 3}", f"t{i}", v) for i, v in enumerate(made)]
    bad = [(9001, "x", "x", None), (9002, "x", "x", [float("nan")] * 8), (9003, "x", "x", [None] * 8), (9004, "x", "x", [float("inf")] * 8)]
    index = cells.build(spark.createDataFrame(bank + bad, BANK), cells=12)
    queries = clustered(60, 2).tolist()
    rows = [(i, v, "kept") for i, v in enumerate([*queries, queries[0], None, [float("nan")] * 8])]
    found = cells.search(spark.createDataFrame(rows, "id int, embedding array<double>, nearest_name string"), index, k=4)
    assert found.columns == ["id", "embedding", "nearest_name", "nearest", "cells_opened"]
    got = {r.id: r for r in found.collect()}
    assert len(got) == 63 and got[61].nearest == [] and got[62].nearest == [] and got[61].cells_opened == 0
    for i, v, _ in rows[:61]:
        assert [n.exemplar_idx for n in got[i].nearest] == flat(v, [(b[0], b[3]) for b in bank], 4)
    opened = [got[i].cells_opened for i in range(61)]
    assert index.cells.count() <= 12 and sum(opened) / len(opened) < 6
    assert index.exemplars.count() == 640 and index.exemplars.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= max(200, 6 * block)


def test_on_disk_few_and_none(spark, tmp_path):
    bank = spark.createDataFrame([(i, "l", "t", [float(i), 1.0]) for i in range(3)], BANK)
    cells.build(bank).write(str(tmp_path / "index"))
    index = cells.Index.read(spark, str(tmp_path / "index"))
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "id int, embedding array<double>")
    got = {r.id: [n.exemplar_idx for n in r.nearest] for r in cells.search(df, index, k=5).collect()}
    assert got == {1: [2, 1, 0], 2: [0, 1, 2]}
    none = cells.build(bank.limit(0))
    assert [r.nearest for r in cells.search(df, none).collect()] == [[], []]
    assert cells.search(df.limit(0), index).count() == 0


def test_tiles_equal_a_full_sort():
    """Ties across the k-th place, tiles of one and many rows, and fewer exemplars than k."""
    rng = np.random.default_rng(4)
    x, m = rng.integers(-2, 3, (50, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    for k in (1, 5, 39, 40, 60):
        for tile in (1, 100, 1 << 20):
            for row, (at, sims) in zip(x, vectors.best_places(x, m, k, tile), strict=True):
                want = np.argsort(-(row @ m.T), kind="stable")[:k]
                assert at.tolist() == want.tolist() and sims.tolist() == (row @ m.T)[want].tolist()


def test_tiles_bound_memory():
    """10,000 rows and 50,000 exemplars, whose products would take 4 GB, are compared in a hundred MB or so."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x, m = rng.normal(size=(10_000, 8)), rng.normal(size=(50_000, 8))
    tracemalloc.start()
    try:
        found = vectors.best_places(x, m, 5)
        for _ in range(300):
            next(found)
        assert tracemalloc.get_traced_memory()[1] < 300e6
    finally:
        tracemalloc.stop()

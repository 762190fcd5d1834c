"""A block of exemplars meets its queries in one product, and ties are those of sums in order."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import cells
from quillstone.plans.registry import QUERIES


def plain(x, m, k):
    out = []
    for i, v in enumerate(x):
        sums = []
        for w in m:
            s = 0.0
            for a, b in zip(v, w, strict=True):
                s = s + a * b
            sums.append(s)
        out += [(i, j, sums[j]) for j in sorted(range(len(m)), key=lambda j: (-sums[j], j))[:k]]
    return out


def test_best_in_block(monkeypatch):
    """Copies of vectors, fewer exemplars than k, tiles of one and many rows: digit by digit."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 64))
    m = np.concatenate([m, m[:17], m[:17]])
    x = np.concatenate([rng.normal(size=(23, 64)), m[:5]])
    for tile in (1, 300, 1 << 21):
        monkeypatch.setattr(cells, "TILE", tile)
        for k in (1, 5, 73, 74, 90):
            assert [tuple(r) for r in zip(*(c.tolist() for c in cells.best_in_block(x, m, k)), strict=True)] == plain(x, m, k)


def test_no_pair_is_a_row(spark):
    """No inner product is worked out by functions of Spark's, pair by pair."""
    found = QUERIES["indexed_nearest"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_null_ids(spark):
    bank = spark.createDataFrame([(None, "a", None, [1.0, 0.0]), (2**62 + 1, None, "t", [1.0, 0.0]), (3, "c", "t", [0.0, 1.0])], "exemplar_idx long, label string, text string, embedding array<double>")
    found = cells.search(spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>"), cells.build(bank), k=2).select(F.explode("nearest").alias("n")).select("n.*").collect()
    assert sorted(((r.exemplar_idx, r.label, r.text, r.similarity) for r in found), key=str) == [(2**62 + 1, None, "t", 1.0), (None, "a", None, 1.0)]

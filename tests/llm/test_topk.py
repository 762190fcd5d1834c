"""Top-k search against a plain brute force, with ties, clashes and values that must not take part."""

import math
import random

import duckdb
import numpy as np
import pytest

from quillstone.llm import topk
from quillstone.llm.queries import ORACLES, op5_exact_top_k


def brute(rows, every, k, scale):
    good = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        near = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(b) == len(a))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(near)]
    return sorted(out)


def check(spark, rows, every=5, k=7, scale=64.0):
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # components as the column's floats
    got = sorted(tuple(r) for r in topk.top_k(df, every=every, k=k, scale=scale).collect())
    assert got == brute(rows, every, k, scale)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    centres = [[rng.gauss(0, 1) for _ in range(40)] for _ in range(5)]
    rows = [(i, unit([c + rng.gauss(0, 0.6) for c in centres[i % 5]])) for i in range(700)]
    check(spark, rows)
    check(spark, rows, k=30)


def test_ties_nulls_and_lengths(spark):
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(60)]
    rows += [(100, None), (105, [1.0, None, 0.0]), (110, [math.nan, 0.0, 0.0]), (115, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(120, [1.0, 2.0]), (121, [2.0, 1.0]), (125, [3.0]), (130, []), (131, []), (200, [1e9, -2e9, 3e9]), (201, [1e9, 2e9, 3e5])]
    check(spark, rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "CELL_CANDIDATES", 64)
    monkeypatch.setattr(topk, "CELL_QUERIES", 4)
    rng = random.Random(5)
    check(spark, [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(20)]) for i in range(300)])


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_ids_in_code_and_sql(spark, tmp_path):
    """Repeated rows are candidates once each; an id with two vectors is two queries, ranked apart."""
    rng = random.Random(6)
    rows = [(i % 90, [rng.choice([-1.0, 0.25, 0.5, 1.0]) for _ in range(8)]) for i in range(200)]
    rows += [rows[0], rows[0], rows[7], (None, [1.0] * 8), (40, None), (41, [math.nan] * 8)]
    check(spark, rows, every=20, k=20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.sql(ORACLES["op5_exact_top_k"]).select("query_id", "rank", "vec_id", "score").fetchall())
    assert sorted(map(tuple, op5_exact_top_k(spark, str(tmp_path)).collect())) == want


def test_large_norms_pass_blocks_over(spark, monkeypatch):
    """A few long vectors and many short ones: results stay exact, and most blocks are never opened."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 30 if i % 16 == 3 else 1) for _ in range(12)]) for i in range(900)]
    check(spark, rows, every=100)


@pytest.mark.parametrize("seed", range(5))
def test_first_floors_bound_the_best(seed):
    rng = np.random.default_rng(seed)
    ids, vectors = rng.integers(0, 20, 60), rng.integers(-9, 9, (60, 7))
    queries, query_ids = rng.integers(-9, 9, (5, 7)), np.arange(5)
    floors = topk.first_floors(queries, query_ids, ids, vectors, 6)
    for q, i, floor in zip(queries, query_ids, floors, strict=True):
        assert floor == sorted((int(q @ v) for c, v in zip(ids, vectors, strict=True) if c != i), reverse=True)[5]
    assert np.isneginf(topk.first_floors(queries, query_ids, ids[:5], vectors[:5], 6)).all()


def test_blocks_are_dealt_evenly(spark):
    rows = topk.scaled(spark.range(40_000).selectExpr("id AS vec_id", "array(float(id % 7), float(id % 5)) AS embedding").repartition(7), "vec_id", "embedding", 64.0)
    blocks = rows.mapInArrow(topk._blocks(500, 8), topk.BLOCKS)
    held = [r.n for r in blocks.groupBy("place").agg({"ids": "count"}).withColumnRenamed("count(ids)", "n").collect()]
    sizes = [r.n for r in blocks.selectExpr("place", "octet_length(ids) / 8 AS size").groupBy("place").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()]
    assert len(held) == 8 and max(sizes) <= 1.5 * min(sizes) and sum(sizes) == 40_000

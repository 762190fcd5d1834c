"""Registered queries: against their SQL where they have it, and none of them empty."""

from pathlib import Path

import duckdb
import pytest

from quillstone.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    assert got
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        assert columns == sorted(want.columns)
        want = sorted(want.select(*columns).fetchall(), key=str)
        wrong = [(a, b) for a, b in zip(got, want) if a != b]
        assert len(got) == len(want) and not wrong, (len(got), len(want), columns, wrong[:3])

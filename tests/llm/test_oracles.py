"""Queries that SQL can express give the rows of their SQL."""

from pathlib import Path

import duckdb
import pytest

from quillstone.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = QUERIES[name](spark, DATA)
    want = db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    assert got == sorted(want.select(*columns).fetchall(), key=str)
    assert got

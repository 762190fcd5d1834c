"""Counting labels asks for no score."""

from quillstone.plans.registry import QUERIES


def test_no_pattern_runs(spark):
    found = QUERIES["clause_types"](spark, "/root/testdata/sf0.001")
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()

"""Patterns and category counts stay out of functions that take functions, which Spark does not compile."""

from pyspark.sql import functions as F

from quillstone.operators import reports, scoring


def tree(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hits(spark):
    rows = spark.range(2).select(F.concat(F.lit("at any time in its sole discretion "), F.col("id").cast("string")).alias("text"))
    found = rows.select(scoring.lexicon_hits(F.col("text"), small=scoring.folded(F.col("text"))).alias("hits"))
    assert "lambda" not in tree(found)
    assert [h["tag"] for h in found.head()["hits"]] == ["unilateral-discretion", "unilateral-timing", "unilateral-discretion"]


def test_category_counts(spark):
    rows = spark.sql("SELECT id AS doc_id, named_struct('categories', IF(id = 0, array('Legal', 'Ambiguity'), CAST(array() AS array<string>))) AS risk FROM range(2)")
    found = reports.category_breakdown(rows)
    assert "lambda" not in tree(found)
    assert {(r.doc_id, r.category): r.n for r in found.collect() if r.n} == {(0, "Legal"): 1, (0, "Ambiguity"): 1}

"""Pages are cleaned once, not once more for the filter of empty ones."""

from quillstone.operators import cleaning


def test_one_cleaning(spark):
    pages = spark.range(3).selectExpr("id AS doc_id", "id AS page_number", "concat('a', CAST(id AS STRING)) AS text")
    plan = cleaning.clean_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [(r.doc_id, r.char_end) for r in cleaning.clean_pages(pages).orderBy("doc_id").collect()] == [(0, 2), (1, 2), (2, 2)]

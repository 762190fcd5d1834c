"""Statistics of documents are grouped once: a distinct count would group by (document, label) before."""

from quillstone.operators import reports

SCHEMA = "doc_id long, label string, skipped boolean, used_context boolean, confidence double"


def test_one_grouping(spark):
    rows = [(1, "a", False, True, 0.5), (1, "a", False, False, 0.9), (1, "b", True, False, 0.1), (1, None, False, False, 0.3), (2, None, False, False, None)]
    found = reports.classification_stats(spark.createDataFrame(rows, SCHEMA))
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert dict(found.dtypes)["n_labels"] == "bigint"
    assert {r.doc_id: (r.n, r.n_labels, r.median) for r in found.collect()} == {1: (4, 2, 0.5), 2: (1, 0, None)}

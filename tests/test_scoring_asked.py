"""Scoring works out what is asked for, and spares ASCII texts what Unicode costs."""

from pyspark.sql import functions as F

from quillstone.operators import scoring
from quillstone.plans.registry import QUERIES
from quillstone.settings import LEXICON, PLACEHOLDERS

TEXTS = [
    "It may change the fees AT ANY TIME in its Sole Discretion.", "in itſ ſole diſcretion, at any time", "no_waive_ waives all\tclaims; 90 (ninety) days",
    "shall not\nfor any reason compete", "shall not for any reason compete", "İrrevocably assign Keep", "", "<<x>> ____ [INSERT A]", "[INSERT", "______ of a long text " * 3, "<<a>>",
]


def scored(spark, **more):
    rows = spark.createDataFrame([(t, 0, len(t), "CLAUSE", "Notices", 0.4, 0.5, False, False) for t in TEXTS], "text string, char_start int, char_end int, structural_role string, label string, confidence double, deviation double, agrees boolean, skipped boolean")
    return scoring.score(rows, **more)


def test_only_what_is_asked_for(spark):
    some = scored(spark, wanted=("level", "score"))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "moderate risk" not in plan and "Financial" not in plan
    assert some.schema["risk"].dataType.names == ["score", "level"]
    assert [tuple(r.risk) for r in some.collect()] == [(r.risk.score, r.risk.level) for r in scored(spark).collect()]


def test_queries_ask_for_what_they_need(spark):
    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Financial" not in plan("risk_hints") and "Financial" not in plan("risk_stats")
    assert "moderate risk" not in plan("category_counts") and "moderate risk" not in plan("risk_stats")


def test_same_hits(spark):
    text = F.col("text")
    rows = scored(spark).select("text", scoring.lexicon_hits(text).alias("plain"), scoring.lexicon_hits(text, small=scoring.folded(text), ascii=scoring.is_ascii(text)).alias("quick"))
    rows = rows.collect()
    assert sum(map(len, (r.plain for r in rows))) > 8 and all(r.plain == r.quick for r in rows)


def test_begins():
    assert [scoring.begins(p) for p in PLACEHOLDERS] == ["<<", "____", "[INSERT"]
    assert [scoring.begins(p) for p in ("a|b", "ab?c", "ab*", "ab+c", "ab{2}c", "ab{0,1}c", r"\d", "(a)", r"a\d")] == ["", "a", "a", "ab", "a", "a", "", "", "a"]
    assert not scoring.simple(r"\p{Punct}") and all(scoring.simple(p) for p, _, _ in LEXICON)


def test_percent(spark):
    values = [0.0, 0.005, 0.015, 0.025, 0.4999, 1.0, -0.001, -0.006, 1e15, None, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    rows = rows.select(scoring.percent(x).alias("got"), F.concat(F.format_string("%.0f", F.bround(x * 100, 0)), F.lit("%")).alias("want")).collect()
    assert [r.got for r in rows[:-3]] == [r.want for r in rows[:-3]]

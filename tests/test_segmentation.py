"""Segmentation in arrays and over parts, against a plain walk from marker to marker."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import segmentation
from quillstone.settings import DEFAULT

from . import plain_segmentation as plain

CONTRACT = """Preface that no marker begins.
WHEREAS the parties wish to trade on the terms below;
1. Definitions. Words in this agreement have their usual meaning.
1.1 Goods are what the order names and what replaces them.
(a) spare parts of all kinds that the buyer may ask for
2. Short
3. TERM
ARTICLE IV Payment is due within thirty days of the invoice.
IN WITNESS WHEREOF the parties have signed this agreement."""
PIECES = [
    "1. ", "1.1 ", "12.3.4. ", "2. ", "(a) ", "(x) ", "(xi) ", "(iv) ", "IX. ", "d. ", "ARTICLE IV ", "Section 2 ", "Clause 3.1 ", "3. Short\n", "WHEREAS ", "NOW, THEREFORE ", "RECITALS ",
    "BY AND\nBETWEEN x ", "word ", "Some longer words here. ", "TERM", "Ǆ TITLE", "é", "—“”", "\n", "\n\n", "\t", " ", "\x1c", "", "", " extraordinarily ", " notwithstanding ", " extraordinarily ",
]


def texts(seed, n, most, pieces=PIECES):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(most))) for _ in range(n)]


def run(spark, rows, settings=DEFAULT):
    found = {}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in segmentation.segment(df, settings).collect():
        found.setdefault(r.doc_id, []).append({k: v for k, v in r.asDict().items() if k != "doc_id"})
    return [sorted(found.get(i, []), key=lambda r: r["clause_id"]) for i in range(len(rows))]


def test_overlaps_keep_the_last_kept():
    m = lambda p, s: plain.Marker(p, s, 1, "x")
    assert [x.position for x in plain.resolved([m(13, 4), m(16, 4), m(21, 3)])] == [13, 21]
    assert [x.position for x in plain.resolved([m(13, 4), m(16, 9)])] == [16]


def test_depth(spark):
    want = {None: 0, "1": 1, "1.1": 2, "1.2.3": 3, "(a)": 2, "(iv)": 3, "(xi)": 2, "IV": 2, "a.": 2, "ARTICLE IV": 1, "Section 1.2": 1, "Clause 3": 1}
    df = spark.createDataFrame([(x,) for x in want], "n string")
    assert {r.n: r.d for r in df.select("n", segmentation.depth_of(F.col("n")).alias("d")).collect()} == want
    assert all(plain.depth_of(x) == d for x, d in want.items())


def test_clauses(spark):
    (found, none) = run(spark, [CONTRACT, "no marker at all"])
    assert [(c["number"], c["level"], c["structural_role"], c["parent_id"]) for c in found] == [
        (None, 1, "RECITAL", None), ("1", 1, "CLAUSE", None), ("1.1", 2, "SUBCLAUSE", 1), ("(a)", 2, "SUBCLAUSE", 1),
        ("3", 1, "CLAUSE", None), ("ARTICLE IV", 1, "CLAUSE", None), (None, 1, "SIGNATURE", None),
    ]
    assert found[3]["text"].endswith("2. Short")  # a fragment goes to the clause before it
    assert all(CONTRACT[c["char_start"] : c["char_end"]] == c["text"] for c in found)
    assert none == []


@pytest.mark.parametrize("changes", [{}, {"keep_preamble": True}, {"ellipsis_drift": False, "overlap_window": 12}, {"normalize_quotes": False, "normalize_dashes": False, "max_level": 2}])
def test_arrays_equal_the_plain_walk(spark, changes):
    settings = DEFAULT.with_(**changes)
    rows = texts(1, 500, 60, [*PIECES, "…"]) + ["", " ", "1. ", "(a) (b) (c) " * 40]
    assert run(spark, rows, settings) == [plain.clauses_of(t, settings) for t in rows]


@pytest.mark.parametrize(("sizes", "changes"), [((300, 40), {}), ((64, 16), {"keep_preamble": True, "deal_parts": True}), ((90, 30), {"overlap_window": 7})])
def test_parts_equal_the_plain_walk(spark, monkeypatch, sizes, changes):
    """Wherever a text is cut, matches, folds, fragments and the hierarchy come out as in one go."""
    monkeypatch.setattr(segmentation, "PARTS", sizes)
    settings = DEFAULT.with_(**changes)
    rows = texts(2, 400, 120) + texts(3, 60, 60, [*PIECES, "…"])
    df = spark.createDataFrame(list(enumerate(rows)), "row long, piece string").withColumn("doc_id", F.col("row")).withColumn("base", F.lit(0))
    cut = df
    for size in sizes:
        cut = segmentation.in_parts(cut, size, settings.overlap_window, settings)
    pieces = {}
    for r in cut.collect():
        pieces.setdefault(r.row, []).append((r.base, r.piece))
    assert all("".join(p for _, p in sorted(pieces[i])) == t for i, t in enumerate(rows)) and sum(len(x) > 3 for x in pieces.values()) > 50
    assert run(spark, rows, settings) == [plain.clauses_of(t, settings) for t in rows]


def test_rows_of_one_id(spark):
    """Rows that repeat a doc_id are segmented each for itself, in arrays and over windows; null texts have no clauses."""
    long = CONTRACT + "\n9. " + "Words that follow each other without end. " * 1000
    df = spark.createDataFrame([(1, CONTRACT), (1, CONTRACT), (1, long), (1, long), (1, None), (None, "1. A text without an id stands here.")], "doc_id long, text string")
    want = 2 * plain.clauses_of(CONTRACT) + 2 * plain.clauses_of(long)
    got = [r.asDict() for r in segmentation.segment(df).collect()]
    assert sorted((c["clause_id"], c["text"]) for c in got if c["doc_id"] == 1) == sorted((c["clause_id"], c["text"]) for c in want)
    assert [c["text"] for c in got if c["doc_id"] is None] == ["1. A text without an id stands here."]


@given(st.lists(st.integers(1, 5), max_size=30))
def test_plain_parents(levels):
    want = [max((j for j in range(i) if levels[j] < levels[i]), default=None) for i in range(len(levels))]
    assert plain.parents(levels) == want


def test_forests(spark):
    """Running maxima by level give the parents of 3,000 random forests, and one grouping their children."""
    rng = random.Random(7)
    forests = [[rng.randint(1, 5) for _ in range(rng.randrange(1, 25))] for _ in range(3000)]
    rows = [(d, 0, i, level) for d, levels in enumerate(forests) for i, level in enumerate(levels)]
    df = spark.createDataFrame(rows, "doc_id int, row int, clause_id int, level int")
    got = {(r.doc_id, r.clause_id): (r.parent_id, r.child_ids) for r in segmentation.with_parents(df, 5).collect()}
    for d, levels in enumerate(forests):
        above = plain.parents(levels)
        assert [got[d, i] for i in range(len(levels))] == [(p, [j for j, q in enumerate(above) if q == i]) for i, p in enumerate(above)]


def test_no_python(spark):
    """Segmentation and the context of parents are plans without Python, and the context reads its clauses once."""
    from quillstone.operators import classification

    docs = spark.createDataFrame([(1, CONTRACT)], "doc_id long, text string")
    clauses = segmentation.segment(docs)
    plan = classification.with_context(clauses)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("InArrow", "InPandas", "EvalPython", "BatchEval")) and "Join" not in plan
    assert clauses._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # that of long texts

"""Plans that must not repeat work, comparison with large banks, models and providers, and every fixed pattern."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import settings as S
from quillstone.functions import text as T
from quillstone.operators import classification, cleaning, explanation, reports, scoring, segmentation, vectors
from quillstone.plans import analysis, contracts, registry
from quillstone.sources import bank, documents
from quillstone.streaming import ingest

DATA = "/root/testdata/sf0.001"


def optimized(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


# ---- plans ----


def test_flagship_runs_each_pattern_once(spark):
    plan = optimized(registry.QUERIES["flagship_contract_risk"](spark, DATA))
    assert len(re.findall(r"RLIKE\(text#\d+, \(\?iuUd\)", plan)) == len(S.LEXICON)


def test_cleaning_is_written_out_once(spark):
    df = spark.createDataFrame([("a", ["x"])], "text string, repeated array<string>")
    for cleaned in (T.clean_text(F.col("text")), T.clean_text(F.col("text"), F.col("repeated"))):
        plan = optimized(df.select(cleaned.alias("c")))
        assert plan.count(r"(\w+)-\n([a-z])") == 1
    plan = optimized(registry.QUERIES["clean_unicode"](spark, DATA))
    assert plan.count(r"(\w+)-\n([a-z])") == 1


def test_audit_and_repeated_lines_read_once(spark):
    # markers are looked for once in texts of usual length, once in long ones; nothing runs in Python
    plan = optimized(registry.QUERIES["offset_audit"](spark, DATA))
    assert plan.count(r"(?<num>\d+(?:\.\d+)+)") == 2 and "MapInArrow" not in plan
    assert optimized(registry.QUERIES["repeated_lines"](spark, DATA)).count("Generate") == 1


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "a\n\n", "\n\na", "a\r\nb", "a\rb\r\n", "a b\x0bc\x0cd\x1ce\x85", "\r\n\r\n", "\n\r"])
def test_lines(spark, text):
    assert values(spark, [text], T.lines) == [text.splitlines()]


# ---- comparison ----


def test_blank_texts_have_no_neighbours(spark):
    near = [{"label": "a", "text": "t", "similarity": 0.9, "exemplar_idx": 0}]
    df = spark.createDataFrame([(i, t, "a", near) for i, t in enumerate(["\n\t", " ", "", None, " ", "x"])], f"i int, text string, label string, nearest {vectors.NEAREST}")
    got = {r.i: r for r in vectors.compared(df, blank_default=True).collect()}
    assert all(got[i].deviation == 1.0 and got[i].max_similarity == 0.0 and got[i].agrees is None for i in range(5))
    assert abs(got[5].deviation - 0.1) < 1e-9 and got[5].agrees


def test_a_bank_beyond_the_bound_is_compared_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist() if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = [(i, f"l{i % 3}", f"t{i}", rng.normal(size=6).tolist()) for i in range(40)]
    exemplars = spark.createDataFrame(made + [(40 + i, "twin", "t", made[i][3]) for i in range(3)], "exemplar_idx int, label string, text string, embedding array<double>")
    key = lambda df: {r.vec_id: [(n.exemplar_idx, n.label, round(n.similarity, 9)) for n in r.nearest] for r in df.collect()}
    whole = key(vectors.nearest(df, exemplars))
    monkeypatch.setattr(vectors, "BANK_ROWS", 12)
    parts = vectors.nearest(df, exemplars)
    assert key(parts) == whole and parts.columns == ["vec_id", "embedding", "nearest"]
    assert whole[0] == [] and len(whole[1]) == S.DEFAULT.neighbours


def test_bank_walk_with_ties_and_missing_parts(spark):
    """Against a plain walk: equal similarities, repeated vectors, null ids and texts, a label of one row."""
    rng = np.random.default_rng(3)
    made = rng.choice([-1.0, 0.0, 1.0], size=(120, 4)) + 0.01
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = [(int(i), "one" if i == 0 else f"l{i % 3}", None if i % 5 else f"t{i}", v.tolist()) for i, v in enumerate(made)]
    rows += [(500, "l1", "zero", [0.0] * 4), (None, "l2", "no id", made[2].tolist())]
    got = vectors.build_bank(spark.createDataFrame(rows, "vec_id long, label string, text string, embedding array<double>"), text="text").collect()
    want = []
    for label in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == label]
        centre = np.mean([r[3] for r in own], axis=0)
        centre = centre / (np.linalg.norm(centre) + 1e-12)
        taken = []
        for r in sorted(own, key=lambda r: (-round(float(np.dot(r[3], centre)), 9), r[0] is not None, r[0])):
            if len(taken) < 5 and all(np.dot(r[3], t[3]) <= 0.85 for t in taken):
                taken.append(r)
        want += [(label, r[0], r[2]) for r in taken]
    assert sorted((r.label, r.original_index, r.text) for r in got if r.original_index is not None) == sorted(w for w in want if w[1] is not None)
    assert {(r.label, r.text) for r in got if r.original_index is None} == {(w[0], w[2]) for w in want if w[1] is None}
    assert sorted(r.exemplar_idx for r in got) == list(range(len(got)))


def test_bank_and_embeddings_on_disk(spark, tmp_path):
    calls = []

    def embed(df):
        calls.append(df.count())
        return vectors.embed(df)

    texts = spark.createDataFrame([(i, f"l{i % 2}", f"text number {i} about thing {i * i}") for i in range(12)], "vec_id long, label string, text string")
    path = str(tmp_path / "vectors")
    one = bank.cached_embeddings(texts, path, embed)
    two = bank.cached_embeddings(texts, path, embed)
    assert calls == [12] and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    made = vectors.build_bank(two, text="text")
    bank.write_bank(made, str(tmp_path / "bank"), "hashed", 5, 0.85)
    read = bank.read_bank(spark, str(tmp_path / "bank"), "hashed")
    assert sorted(map(str, read.collect())) == sorted(map(str, made.collect()))
    about = spark.read.parquet(str(tmp_path / "bank" / "about")).first()
    assert (about.num_vectors, about.num_labels, about.embedding_dim) == (made.count(), 2, 256)
    with pytest.raises(ValueError, match="made with hashed"):
        bank.read_bank(spark, str(tmp_path / "bank"), "another")
    made.limit(1).write.mode("append").parquet(str(tmp_path / "bank" / "exemplars"))
    with pytest.raises(ValueError, match="should have"):
        bank.read_bank(spark, str(tmp_path / "bank"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bank.read_bank(spark, str(tmp_path / "nothing"))
    # another number of rows replaces the vectors
    assert bank.cached_embeddings(texts.where("vec_id < 9"), path, embed).count() == 9 and calls == [12, 9]


# ---- streams and sources ----


def test_a_latin_1_file_does_not_end_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("1. café whatsoever\r\nx".encode("latin-1"))
    (tmp_path / "in" / "b.txt").write_bytes("1. naïve text of this kind".encode())
    query = ingest.text_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("latin").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.text for r in spark.table("latin").collect()} == {"1. café whatsoever\nx", "1. naïve text of this kind"}


def test_upload_guard(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * 300)
    (tmp_path / "small.txt").write_bytes(b"y" * 200)
    got = {r.source_path.rsplit("/", 1)[-1]: r.error for r in documents.load(spark, str(tmp_path), S.DEFAULT.with_(max_upload_bytes=250)).collect()}
    assert got["small.txt"] is None and got["big.txt"]
    assert documents.upload_name("a b/ü.txt", "t") == "t_a_b__.txt"


def test_settings_files(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"min_text_length": 5, "extensions": ["txt"]}))
    (tmp_path / "s.yaml").write_text("high: 0.9\nextensions: [txt, pdf]\n")
    assert S.load_settings(str(tmp_path / "s.json")) == S.DEFAULT.with_(min_text_length=5, extensions=("txt",))
    assert S.load_settings(str(tmp_path / "s.yaml")) == S.DEFAULT.with_(high=0.9, extensions=("txt", "pdf"))
    with pytest.raises(TypeError):
        (tmp_path / "t.json").write_text('{"no_such": 1}')
        S.load_settings(str(tmp_path / "t.json"))


# ---- classification ----


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"payment of fee number {i} is due", "Payments") for i in range(20)] + [(f"notice number {i} in writing to the address", "Notices") for i in range(20)]
    return classification.HashedLogistic.fit(spark.createDataFrame(rows, "text string, label string"), features=1 << 10)


def test_classify(spark, model):
    rows = [
        (1, 0, "Payment of the fee is due.", None, "CLAUSE", "1"), (1, 1, "in writing to the address", 0, "SUBCLAUSE", "(a)"), (1, 2, "WHEREAS payment is due", None, "RECITAL", None),
        (1, 3, " \n", None, "CLAUSE", "2"), (2, 0, "notice in writing", None, "CLAUSE", None),
    ]
    clauses = spark.createDataFrame(rows, "doc_id long, clause_id int, text string, parent_id int, structural_role string, number string")
    got = {(r.doc_id, r.clause_id): r for r in classification.classify(clauses, model).collect()}
    assert len(got) == 5
    assert got[1, 0].label == "Payments" and got[2, 0].label == "Notices" and not got[1, 0].used_context
    assert got[1, 1].used_context and got[1, 1].label in ("Payments", "Notices")
    assert (got[1, 2].label, got[1, 2].confidence, got[1, 2].skipped) == ("RECITAL", 1.0, True)
    assert (got[1, 3].label, got[1, 3].confidence, got[1, 3].top_k) == (None, 0.0, [])
    for k in ((1, 0), (1, 1), (2, 0)):
        p = [x.probability for x in got[k].top_k]
        assert p == sorted(p, reverse=True) and abs(sum(p) - 1) < 1e-9 and got[k].confidence == p[0] and got[k].label == got[k].top_k[0].label


def test_context_comes_before_the_text(spark):
    df = spark.createDataFrame([("own", "ctx"), ("own", None)], "t string, c string")
    assert [r[0] for r in df.select(classification.with_prefix(F.col("t"), F.col("c"))).collect()] == ["ctx\n\nown", "own"]


def test_softmax_and_ranking(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0], ["a", "b", "c"]), ([1000.0, 1000.0, -1000.0], ["z", "a", "m"])], "x array<double>, l array<string>")
    got = df.select(classification.ranked(classification.softmax(F.col("x")), F.col("l")).alias("r")).collect()
    e = np.exp([1.0, 3.0, 2.0])
    assert [x.label for x in got[0].r] == ["b", "c", "a"] and np.allclose([x.probability for x in got[0].r], sorted(e / e.sum(), reverse=True))
    assert [x.label for x in got[1].r] == ["a", "z", "m"]


def test_model_on_disk(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    df = spark.createDataFrame([("payment is due",), (None,)], "text string")
    same = classification.HashedLogistic.load(str(tmp_path / "m"))
    assert same.predict(df).collect() == model.predict(df).collect()
    with pytest.raises(Exception):
        classification.HashedLogistic.load(str(tmp_path / "none"))


# ---- explanations ----


def scored(spark):
    return scoring.score(contracts.clauses(spark, DATA))


def test_chain_of_providers(spark):
    def broken(prompt):
        raise RuntimeError("no answer")

    def fine(prompt):
        return "EXPLANATION: because\nSUGGESTED ACTION: do"

    rows = scored(spark).where("risk.level <> 'low'").limit(5)
    got = explanation.explain(rows, {"first": broken, "second": fine}).collect()
    assert got and all((r.explanation.text, r.explanation.suggested_action, r.explanation.model_used, r.explanation.skipped_reason) == ("because", "do", "second", None) for r in got)
    got = explanation.explain(rows, {"first": broken}).collect()
    assert all(r.explanation.text is None and r.explanation.skipped_reason == "all models failed: first: RuntimeError: no answer" for r in got)
    high = explanation.explain(scored(spark).limit(200), {"second": fine}, S.DEFAULT.with_(explain_at="high")).collect()
    assert {r.explanation.skipped_reason for r in high if r.risk.level != "high"} == {explanation.SKIPPED}


def test_prompt_says_what_is_known(spark):
    row = scored(spark).where("risk.level = 'high' AND size(risk.signals.risky_language_tags) > 0 AND label IS NOT NULL").withColumn("p", explanation.prompt_of(F.col("text"), F.col("label"), F.col("risk"))).first()
    for part in (row.text, row.label, row.risk.level, f"{row.risk.score:.2f}", row.risk.hint, row.risk.signals.risky_language_tags[0], *row.risk.categories, *S.REPLY_HEADINGS):
        assert part in row.p
    bare = spark.sql("SELECT ' x ' AS text, CAST(NULL AS STRING) AS label, named_struct('level', 'medium', 'score', 0.5D, 'categories', array(), 'hint', 'h', 'signals', named_struct('risky_language_tags', array())) AS risk")
    prompt = bare.select(explanation.prompt_of(F.col("text"), F.col("label"), F.col("risk"))).first()[0]
    assert "unknown" in prompt and "Concerns" not in prompt and "Wording" not in prompt


def test_explanations_can_be_left_out(spark, model):
    docs = spark.createDataFrame([(1, "1. Payment of the fee is due at any time in its sole discretion.\n2. Notice is given in writing to the address.")], "doc_id long, text string")
    exemplars = vectors.build_bank(vectors.embed(spark.createDataFrame([(1, "Payments", "payment of the fee"), (2, "Notices", "notice in writing")], "vec_id long, label string, text string")), text="text")
    rows = analysis.analyze(docs, model, exemplars, explain=False).collect()
    assert len(rows) == 2 and all(r.explanation.skipped_reason == "explanations disabled" and r.explanation.text is None for r in rows)
    whole = analysis.responses(analysis.analyze(docs, model, exemplars)).first()
    assert [c.id for c in whole.clauses] == [0, 1] and whole.summary.total_clauses == 2
    assert analysis.health(model, exemplars, {"t": explanation.template})["status"] == "ok"
    assert analysis.health(None, exemplars, None) == {"status": "degraded", "model": False, "bank": True, "explanations": False}


# ---- every fixed pattern ----


def test_the_marked_contracts_meet_every_marker_pattern():
    text = "\n".join(contracts.MARKED).format(k=7, c=3)
    for pattern in S.NUMBERING:
        assert re.search(pattern, text), pattern
    for pattern, _ in S.STRUCTURAL:
        assert re.search(pattern, text, re.M), pattern


def test_curly_quotes_and_dashes_are_plain_for_matching(spark):
    quoted = spark.createDataFrame([("‘a’ “b” – — …",)], "t string").select(segmentation.for_matching(F.col("t"))).first()[0]
    assert quoted == "'a' \"b\" - - ..."


def test_page_offsets_and_given_lines(spark):
    pages = spark.createDataFrame([(1, 1, "a  b \nDraft"), (1, 2, " 12 "), (1, 3, "c")], "doc_id long, page_number int, text string")
    got = {r.page_number: (r.text, r.char_start, r.char_end) for r in cleaning.clean_pages(pages).collect()}
    assert got == {1: ("a b", 0, 3), 3: ("c", 3, 4)}
    assert values(spark, ["keep\n go  away \nkeep"], lambda c: T.without_lines(c, F.array(F.lit("go away")))) == ["keep\nkeep"]
    assert values(spark, ["x\ny"], lambda c: T.without_lines(c, F.lit(None).cast("array<string>"))) == ["x\ny"]


def test_dates(spark):
    got = values(spark, ["2024-03-05T10:00:00Z", "2024-12-31 23:59:59", "", None, "soon"], T.shown_date)
    assert got == ["Mar 5, 2024", "Dec 31, 2024", "—", "—", "soon"]


def test_order_by_deviation(spark):
    rows = reports.by_deviation(contracts.clauses(spark, DATA)).select("doc_id", "skipped", "deviation", "clause_id").collect()
    assert rows == sorted(rows, key=lambda r: (r.doc_id, r.skipped, -r.deviation, r.clause_id))

"""Operators on small cases of our own: segmentation, scoring, cleaning, classification, sources, store."""

import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import classification, cleaning, explanation, scoring, segmentation, vectors
from quillstone.plans import registry
from quillstone.settings import DEFAULT
from quillstone.sources import documents, store


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


# ---- scoring ----


def test_score_invariants(spark):
    rng = random.Random(1)
    words = ["sole discretion", "at any time", "perpetual", "in perpetuity", "waives all", "no waiver", "plain words here", "____ ____", "evergreen", "hold harmless"]
    rows = [
        (i, t := " ".join(rng.choices(words, k=rng.randint(1, 8))), 0, len(t), "CLAUSE", rng.choice([None, "Terminations", "Headings", "Fees"]), rng.random(), rng.random(), rng.choice([None, True, False]), rng.random() < 0.1)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id int, text string, char_start int, char_end int, structural_role string, label string, confidence double, deviation double, agrees boolean, skipped boolean")
    for r in scoring.score(df).collect():
        s = r.risk.signals
        assert 0 <= r.risk.score <= 1
        if r.skipped:
            assert (r.risk.score, r.risk.level, r.risk.categories) == (0, "low", [])
            continue
        if s.risky_language_score >= 0.85:
            assert r.risk.level == "high"
        elif s.risky_language_score >= 0.65:
            assert r.risk.level in ("medium", "high")
        if r.confidence < 0.25 and s.risky_language_score < 0.5:
            assert r.risk.level == "low"
        assert len(set(r.risk.categories)) == len(r.risk.categories)


def test_duplicate_patterns_count_twice(spark):
    (hits,) = values(spark, ["in its SOLE discretion"], scoring.lexicon_hits)
    assert [h.tag for h in hits] == ["unilateral-discretion"] * 2


# ---- cleaning ----


def test_cleaning(spark):
    got = values(spark, ["ﬁrst insur-\nance Foo-\nBar", "a b", "x  \t y \n\n\n\n z ", None], T.clean_text)
    assert got == ["first insurance Foo-\nBar", "a b", "x y\n\n z", None]
    assert values(spark, ["a b  c"], T.collapse_whitespace) == ["ab c"]
    assert values(spark, ["Page 3 of 9\nkept\n12\n– 4 –\nconfidential\nDRAFT \nDrafts"], T.without_footers) == ["kept\nDrafts"]
    assert values(spark, ["a\x0cb c\n", ""], T.lines) == [["a", "b", "c"], []]


def test_repeated_lines(spark):
    rows = [(1, p, f"Header\nbody {p}\n{'common' if p < 2 else 'rare'}") for p in range(4)] + [(2, 0, "one\ntwo"), (2, 1, "three\nfour")]
    pages = spark.createDataFrame(rows, "doc_id int, page_number int, text string")
    got = {tuple(r) for r in cleaning.repeated_lines(pages).collect()}
    assert got == {(1, "Header"), (1, "common"), (1, "rare"), (2, "one"), (2, "two"), (2, "three"), (2, "four")}
    assert {r.doc_id for r in cleaning.repeated_lines(pages, DEFAULT.with_(min_repeat_pages=2)).collect()} == {1}


# ---- classification, vectors, explanation ----


def test_context(spark):
    text = lambda s: classification.context_of(F.lit(s), F.lit("2"))
    row = spark.range(1).select(
        text("1. Goods. More").alias("number"), text("Goods: what; else. Next").alias("stop"), text("w " * 200).alias("long"), text("x" * 300).alias("solid"), text(None).alias("none")
    ).first()
    assert row.number == "[Context: parent clause 2]: 1. "
    assert row.stop == "[Context: parent clause 2]: Goods: what; else. "
    assert row.long == "[Context: parent clause 2]: " + ("w " * 100)[:199] + "..."
    assert row.solid == "[Context: parent clause 2]: " + "x" * 200 + "..."
    assert row.none is None


def test_nearest_and_agreement(spark):
    bank = spark.createDataFrame([(0, "a", "x", [1.0, 0.0]), (1, "b", "y", [0.0, 1.0]), (2, "a", "z", [1.0, 0.0])], "exemplar_idx int, label string, text string, embedding array<double>")
    df = spark.createDataFrame([(1, "a", [0.6, 0.8]), (2, None, [1.0, 0.0]), (3, "b", [-1.0, 0.0]), (4, "b", None)], "id int, label string, embedding array<double>")
    got = {r.id: r for r in vectors.compared(vectors.nearest(df, bank)).collect()}
    assert [n.exemplar_idx for n in got[2].nearest] == [0, 2, 1] and got[2].agrees is None
    assert got[1].agrees is False and abs(got[1].mean_top3_similarity - 2 / 3) < 1e-9
    assert got[3].deviation == 1.0 and got[4].nearest == [] and got[4].deviation == 1.0 and got[4].agrees is None


def test_bank_against_a_plain_walk(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    got = vectors.build_bank(spark.createDataFrame(rows)).collect()
    want = []
    for label in sorted({r.label for r in rows}, key=str):
        own = [r for r in rows if r.label == label]
        centre = np.mean([np.array(r.embedding, float) for r in own], axis=0)
        centre /= np.linalg.norm(centre)
        taken = []
        for r in sorted(own, key=lambda r: (-float(np.array(r.embedding, float) @ centre), r.vec_id)):
            v = np.array(r.embedding, float)
            if len(taken) < 5 and all(v @ np.array(t.embedding, float) <= 0.85 for t in taken):
                taken.append(r)
        want += [(str(label), r.vec_id) for r in taken]
    assert sorted((r.label, r.original_index) for r in got) == sorted(want)


def test_comparison_is_with_the_bank_of_all_labels(spark, tmp_path):
    """Two labels have no vec_id below 50; brute force over the whole table's bank."""
    rng = np.random.default_rng(5)
    made = rng.normal(size=(90, 8)) + 2 * np.eye(8)[np.repeat([0, 1, 2], 30)]
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = [(i, int(i // 30), v.astype(np.float32).tolist()) for i, v in enumerate(made)]
    rows = [(i if k == 0 else i + 50, k, v) for i, k, v in rows]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bank = []
    for label in range(3):
        own = [(i, np.array(v, np.float64)) for i, k, v in rows if k == label]
        centre = np.mean([v for _, v in own], axis=0)
        taken = []
        for _, v in sorted(own, key=lambda x: (-float(x[1] @ centre), x[0])):
            if len(taken) < 5 and all(v @ t <= 0.85 for t in taken):
                taken.append(v)
        bank += [(label, v) for v in taken]
    got = {r.vec_id: r for r in registry.QUERIES["bank_comparison"](spark, str(tmp_path)).collect()}
    assert len(got) == 90
    for i, k, v in rows:
        near = sorted(((float(np.array(v, np.float64) @ b), label) for label, b in bank), key=lambda x: -x[0])
        assert abs(got[i].max_similarity - near[0][0]) < 2e-5 and abs(got[i].deviation - 1 + near[0][0]) < 2e-5
        assert abs(got[i].mean_top3 - sum(s for s, _ in near[:3]) / 3) < 2e-5
        assert got[i].agrees == (near[0][1] == k)
    assert any(r.agrees for i, r in got.items() if i >= 80)


def test_replies_and_retries(spark):
    texts = ["EXPLANATION: a\nSUGGESTED ACTION: b", " only text ", "SUGGESTED ACTION: b EXPLANATION: a"]
    got = values(spark, texts, explanation.parsed)
    assert [tuple(x) if x else None for x in got] == [("a", "b"), ("only text", ""), None]
    calls, pauses = [], []

    def provider(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise explanation.Busy
        return "fine"

    assert explanation.asked(provider, "p", 2, pauses.append) == "fine" and pauses == [1.0, 2.0]


# ---- sources and store ----


def test_documents(spark, tmp_path):
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("First paragraph", " ", "Second one"))
    with zipfile.ZipFile(tmp_path / "a.DOCX", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    (tmp_path / "b.txt").write_bytes("héllo\r\nworld\rx".encode())
    (tmp_path / "c.txt").write_bytes("h\xe9llo".encode("latin-1"))
    (tmp_path / "d.txt").write_bytes(b" \n ")
    (tmp_path / "e.exe").write_bytes(b"x")
    (tmp_path / "f.pdf").write_bytes(b"one|two||four")
    (tmp_path / "g.docx").write_bytes(b"not a zip")
    read = documents.load(spark, str(tmp_path), pdf_reader=lambda data: (data.decode().split("|"), {"page_count": "4"}))
    got = {r.source_path.rsplit("/", 1)[-1]: r for r in read.collect()}
    assert got["a.DOCX"].full_text == "First paragraph\nSecond one" and got["a.DOCX"].metadata["paragraph_count"] == "2"
    assert got["b.txt"].full_text == "héllo\nworld\nx" and got["c.txt"].full_text == "héllo" and got["c.txt"].metadata["encoding_used"] == "latin-1"
    assert got["d.txt"].error == "no text" and "unsupported" in got["e.exe"].error and got["g.docx"].error
    assert [(p.page_number, p.char_start, p.char_end) for p in got["f.pdf"].pages] == [(1, 0, 3), (2, 3, 6), (4, 6, 10)]
    checked = {r.doc_id.rsplit("/", 1)[-1]: r.error for r in documents.ingest(spark, str(tmp_path)).collect()}
    assert len(checked) == 7 and "too short" in checked["b.txt"] and "no PDF reader" in checked["f.pdf"]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.init()
    s.init()
    one, two = s.add_user(" A@x.org ", " Ann ", "h"), s.add_user("b@x.org", "Bo", "h")
    with pytest.raises(ValueError):
        s.add_user("a@X.org", "Other", "h")
    assert s.user_by_email("A@X.ORG").first().full_name == "Ann" and s.user_by_id(two).count() == 1
    rows = [(one, "f.txt", f"d{i}", i, '{"a":1}') for i in range(3)] + [(two, "g.txt", "e", 1, "{}")]
    df = spark.createDataFrame(rows, "user_id long, filename string, id string, high_count int, analysis_json string")
    for name in store.LISTED:
        if name not in df.columns and name not in ("created_at",):
            df = df.withColumn(name, F.lit(None).cast("string"))
    s.add_documents(df)
    assert [r.id for r in s.list_documents(one, 2).collect()] == ["d0", "d1"] and s.count_documents(one) == 3
    assert s.document("d1", two).isEmpty() and not s.delete_document("d1", two)
    assert s.delete_document("d1", one) and s.count_documents(one) == 2
    assert s.document("d0", one).select(store.from_json(F.col("analysis_json"), "a int").alias("x")).first().x.a == 1
    assert s.delete_user(one) and s.count_documents(one) == 0 and s.count_documents(two) == 1 and s.users().count() == 1


def test_the_whole_analysis_has_the_classifier_of_the_defaults(spark):
    model, _ = registry._model_and_bank(spark, "/root/testdata/sf0.001")
    stages = model.pipeline.stages
    assert [s.getNumFeatures() for s in stages if hasattr(s, "getNumFeatures")] == [1 << 14]
    assert [s.getMaxIter() for s in stages if hasattr(s, "getMaxIter")] == [40]

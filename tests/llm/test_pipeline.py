"""The pipeline's stages against plain versions of their decisions."""

from collections import defaultdict

import corpus_pipeline
import pytest
from tests.llm.test_jaccard import brute

from quillstone.llm import jaccard, language, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filters_keep_rows_whole(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for kept, wanted in (
        (toxicity.without_toxic(docs, m := toxicity.fit(docs, labels)), toxicity.score(docs, m).where("predicted = 0")),
        (language.in_known_language(docs, n := language.fit(docs)), language.identify(docs, n).where("lang_pred <> 'und' and score >= 0.4")),
    ):
        assert kept.schema == docs.schema
        assert rows(kept) == rows(docs.join(wanted.select("doc_id"), "doc_id", "left_semi").select(*docs.columns))


def test_one_of_each_group(spark, docs):
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    keep = {d for d, _, c in brute(plain) if d == c}
    assert rows(jaccard.one_of_each(docs)) == rows(docs.where(docs.doc_id.isin(*keep)))


def test_repeated_rows_and_nulls(spark, monkeypatch):
    data = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, "x"), (4, "", None), (3, None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, component_id string")
    want = sorted([data[0], data[3], data[4], data[5]], key=str)
    assert rows(jaccard.one_of_each(df)) == want
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    assert rows(jaccard.one_of_each(df)) == want


def test_run(spark, docs):
    found = corpus_pipeline.run(spark, DATA).collect()
    held = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, DATA)
        assert held.columns == docs.columns
    tokens = defaultdict(int)
    for r in found:
        tokens[r.doc_id] += r.length
        assert r.start + r.length <= r.doc_tokens
    assert set(tokens) == {r.doc_id for r in held.select("doc_id").collect()}
    assert all(tokens[r.doc_id] == r.doc_tokens for r in found)
    assert 0 < len(tokens) < docs.count()


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")


def test_run_on_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_with_nulls_and_repeated_rows(spark, docs, tmp_path):
    """Rows that lack things go through every stage; the stages' decisions are as their docstrings say."""
    plain = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.where("doc_id is not null").limit(120).collect()]
    clean = "the house and the garden are here and the people of the town are there with the children"
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (None, clean, None, None, None), (10**6 + 2, clean, "en", None, 1), (10**6 + 2, clean, "en", None, 1)]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    write(spark, tmp_path, plain + odd, labels + [(None, None, None), (10**6, None, None)])
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        kept[name] = [r.doc_id for r in held.collect()]
    assert kept["toxicity"].count(10**6 + 2) == 2 and {None, 10**6, 10**6 + 1} <= set(kept["toxicity"])
    assert not {10**6, 10**6 + 1} & set(kept["language"]) and kept["language"].count(10**6 + 2) == 2
    assert kept["near_duplicates"].count(10**6 + 2) == 1 and None in kept["near_duplicates"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept["near_duplicates"])

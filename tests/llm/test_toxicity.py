"""Toxicity: segments against brute force, held-out accuracy, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import toxicity


def brute(x):
    """Maximal segments by their definition: take the best segment, then go on left and right of it."""
    best = max(((sum(x[i:j]), -(j - i), -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return brute(x[:i]) + [(i, j, best[0])] + [(a + j, b + j, v) for a, b, v in brute(x[j:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6).filter(bool), max_size=25))
def test_segments_equal_brute_force(x):
    # unequal sums only: powers of an odd base keep totals apart
    x = [v + i * 1e-3 * (1 if v > 0 else -1) for i, v in enumerate(x)]
    got = toxicity.maximal_segments(np.array(x))
    want = brute(x)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rude = ["grumpfa", "grumpfo", "grumpfi", "snarkle"]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(5, 150))
        toxic = int(rng.random() < 0.25)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(rude, k=rng.randint(1, 3))
        docs.append((i, " ".join(words), "x", 0.0))
        labels.append((i, 1, toxic))
    docs += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (1002, "!!! ...", "x", 0.0), (None, "grumpfa grumpfo", "x", 0.0), (1003, "grumpfu " * 50_000, "x", 0.0), (1003, "ok", "x", 0.0)]
    labels += [(1000, 1, 0), (None, 1, 1), (5000, 0, 1), (3, 1, None), (4, 1, 7)]
    schema = "doc_id long, text string, segments string, score double"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(made):
    docs, labels = made
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") < 600)).collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95


def test_spans_and_edges(made):
    docs, labels = made
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {(r.doc_id, r.predicted): r for r in got}
    assert (1000, 0) in by_id and (1001, 0) in by_id and (1002, 0) in by_id
    assert by_id[(None, 1)].segments[0].start == 0 and by_id[(None, 1)].segments[0].end == 15
    assert (1003, 1) in by_id and (1003, 0) in by_id  # an unseen form of a known beginning, and a plain text


def test_empty_tables_and_one_class(made):
    docs, labels = made
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0")):
        scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()}
        assert len(scores) == 1 and max(scores) < 0.5


def plain_score(text, model):
    """A document's score from its definition, segments by brute force."""
    words = re.findall(r"\w+", (text or "").lower())
    found = brute([float(x) - toxicity.DRIFT for x in model.log_odds(words)])
    chance = model.constant + math.log(max(1, len(words)))
    surplus = [model.rate * v - chance for _, _, v in found]
    a, b, c = model.curve
    x = a + b * math.asinh(max([*surplus, -chance])) + c * math.log(1 + sum(v > toxicity.SIGNIFICANT for v in surplus))
    return 1 / (1 + math.exp(-x))


def test_counts_and_scores_equal_plain_ones(made):
    docs, labels = made
    model = toxicity.fit(docs, labels)
    label = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and r.doc_id is not None}
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 0
    rows = docs.where("doc_id is not null").select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("out"), aside.alias("aside")).collect()
    seen = {0: Counter(), 1: Counter()}
    for r in rows:
        if r.doc_id in label and not r.out and not r.aside:
            seen[label[r.doc_id]].update(re.findall(r"\w+", (r.text or "").lower()))
    share = sum(seen[1].values()) / (sum(seen[0].values()) + sum(seen[1].values()))
    for word in [*list(seen[0])[:60], *seen[1], "grumpfzz", "neverseen"]:
        toxic = share
        for k in (4, 6, None):
            held = [sum(n for w, n in seen[y].items() if (w == word if k is None else w[:k] == word[:k])) for y in (0, 1)]
            toxic = (held[1] + toxicity.STRENGTH * toxic) / (sum(held) + toxicity.STRENGTH)
        assert math.isclose(model.log_odds([word])[0], math.log(toxic / (1 - toxic)) - math.log(share / (1 - share)), rel_tol=1e-9), word
    short = docs.where("length(coalesce(text, '')) < 260")
    got = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score(short, model).collect())
    assert len(got) > 50
    assert got == sorted((str(r.doc_id), round(plain_score(r.text, model), 9)) for r in short.collect())


def test_calibration_finds_the_law():
    """Best segments of texts of one length, drawn from a Gumbel law, give back its rate and constant."""
    rng = np.random.default_rng(4)
    rate, constant = 0.8, -1.5
    n = np.full(4000, 300)
    best = (constant + np.log(n) + rng.gumbel(size=len(n))) / rate
    model = toxicity.Model()
    toxicity.calibrate(model, list(zip(n.tolist(), best.tolist(), strict=True)))
    assert abs(model.constant - constant) < 0.2 and abs(model.rate - rate) < 0.05
    unset = toxicity.Model()
    toxicity.calibrate(unset, [(5, 1.0)] * 19 + [(0, None), (7, None)])
    assert (unset.rate, unset.constant) == (1.0, 0.0)


def test_long_words_and_many_passages(spark):
    """A word of sixty letters is known whole, and each of a hundred passages is found."""
    long = "".join(random.Random(2).choice("abcdefgh") for _ in range(60))
    twin = long[:59] + "z"  # differs in the last letter alone
    docs, labels = [], []
    rng = random.Random(3)
    for i in range(900):
        words = [f"word{rng.randrange(200)}" for _ in range(40)]
        toxic = i % 3 == 0
        words[rng.randrange(40)] = long if toxic else twin
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    assert model.log_odds([long])[0] > 2 > 0 > model.log_odds([twin])[0]
    many = " ".join(" ".join([long] * 3 + [f"word{i % 200}"] * 60) for i in range(100))
    row = toxicity.score(spark.createDataFrame([(1, many)], "doc_id long, text string"), model).first()
    assert len(row.segments) == 100 and row.predicted == 1
    assert all(many[s.start : s.end] == " ".join([long] * 3) for s in row.segments)


def test_filter_edges(spark, made):
    docs, labels = made
    model = toxicity.fit(docs, labels)
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[(1000, None)] == got[(1001, "")] == got[(1002, "!!! ...")] == got[(1003, "ok")] == 1
    assert got[(None, "grumpfa grumpfo")] == 0 and all(t is None or len(t) < 50_000 for _, t in got)
    assert toxicity.without_toxic(docs.limit(0), model).count() == 0
    twice = docs.where("doc_id in (1, 2, 1001)").unionByName(docs.where("doc_id in (1, 2, 1001)"))
    assert all(n == 2 for n in Counter((r.doc_id, r.text) for r in toxicity.without_toxic(twice, model).collect()).values())

"""Language identification: forward-backward against enumeration, held-out accuracy, edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import language
from quillstone.llm.toxicity import held_out


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths, states = np.array([3, 1, 4, 2]), 3
    potentials, transitions = rng.normal(size=(lengths.sum(), states)) * 2, rng.normal(size=(states, states))
    marginals, moves, log_z = language.forward_backward(potentials, lengths, transitions)
    want, want_moves, want_z, at = np.zeros_like(marginals), np.zeros_like(moves), 0.0, 0
    for n in lengths:
        z, m, t = 0.0, np.zeros((n, states)), np.zeros((states, states))
        for y in itertools.product(range(states), repeat=int(n)):
            w = np.exp(sum(potentials[at + i, y[i]] for i in range(n)) + sum(transitions[a, b] for a, b in itertools.pairwise(y)))
            z += w
            for i in range(n):
                m[i, y[i]] += w
            for a, b in itertools.pairwise(y):
                t[a, b] += w
        want[at : at + n], at = m / z, at + n
        want_moves += t / z
        want_z += np.log(z)
    assert np.allclose(marginals, want)
    assert np.allclose(moves, want_moves)
    assert np.isclose(log_z, want_z)


def test_chains_hold_every_word():
    text = "Eins zwei\n\ndrei " + "x " * 1000 + "y" * 100 + "\r\nÄÖ 12 _a_"
    words = [w for c in language.chains(text) for w in c]
    assert "".join(words) == "einszweidrei" + "x" * 1000 + "y" * 100 + "äöa"
    assert max(map(len, language.chains(text))) <= language.CHAIN


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs, sample=60)


def test_held_out_accuracy(docs, model):
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_a_mixed_line(docs, model):
    """In a line of two languages, most words get the language that they came from."""
    part = {r.lang: r.text for r in docs.where("n_chars between 300 and 3000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    chain = language.chains(part["de"].replace("\n", " "))[0][:30] + language.chains(part["fr"].replace("\n", " "))[0][:30]
    lexicon = language.Lexicon(model)
    at = lexicon.numbers(chain)
    marginals, _, _ = language.forward_backward(lexicon.table()[at], np.array([60]), model.transitions)
    got = [model.languages[k] for k in marginals.argmax(axis=1)]
    assert got[:30].count("de") > 24 and got[30:].count("fr") > 24


def mixed(texts, seed):
    """(words, languages) of lines of two to four pieces of texts in different languages."""
    rng, out = np.random.default_rng(seed), []
    words = {lang: [w for c in language.chains(t) for w in c] for lang, t in texts}
    names = sorted(words)
    for _ in range(200):
        line, langs, last = [], [], None
        for _ in range(rng.integers(2, 5)):
            last = lang = rng.choice([x for x in names if x != last])
            at, n = rng.integers(len(words[lang]) - 20), rng.integers(3, 15)
            line += words[lang][at : at + n]
            langs += [lang] * n
        out.append((line, langs))
    return out


def test_word_accuracy_on_mixed_lines(docs, model):
    """Held-out texts cut and joined: nearly all words get the language that they came from, and switches are learned."""
    rows = docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("n_chars") > 400)).collect()
    lines = mixed([(lang, "\n".join(r.text for r in rows if r.lang == lang)) for lang in {r.lang for r in rows}], 4)
    lexicon, right, total = language.Lexicon(model), 0, 0
    for words, langs in lines:
        at = lexicon.numbers(words)
        marginals, _, _ = language.forward_backward(lexicon.table()[at], np.array([len(words)]), model.transitions)
        got = [model.languages[k] for k in marginals.argmax(axis=1)]
        right, total = right + sum(a == b for a, b in zip(got, langs, strict=True)), total + len(langs)
    print("word accuracy on mixed lines", right / total)
    assert right / total > 0.93


def test_joined_chains():
    rng = np.random.default_rng(5)
    lines = [(f"l{k}", [f"l{k}w{rng.integers(99)}" for _ in range(n)]) for k in range(3) for n in rng.integers(1, 30, 30)]
    out = language.joined(lines)
    assert len(out) == len(lines) // language.JOINED and out == language.joined(lines[::-1])
    for langs, words in out:
        assert all(w.startswith(lang + "w") for lang, w in zip(langs, words, strict=True))
        assert len(set(langs)) > 1
    assert language.joined([x for x in lines if x[0] == "l0"]) == []
    model = language.train(lines + out, ["l0", "l1", "l2"])
    staying = np.diag(model.transitions).min() - (model.transitions - np.diag(np.full(3, np.inf))).max()
    assert staying > 0


def test_transitions_come_from_data():
    """A language that always switches to another one learns so."""
    rng = np.random.default_rng(6)
    lines = []
    for _ in range(120):
        langs = ["l0", "l1"] * 8 if rng.random() < 0.5 else ["l1", "l0"] * 8
        lines.append((langs, [invented(rng, int(x[1]), 1)[0] for x in langs]))
    moves = language.train(lines, ["l0", "l1"]).transitions
    assert moves[0, 1] > moves[0, 0] and moves[1, 0] > moves[1, 1]


def test_document_scores_equal_enumeration(spark, model):
    """Shares of a document's words by listing all labellings of its short lines."""
    texts = ["der hund the dog", "le chat\nund die katze ist", "perro the gato and", "ein"]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    lexicon, k = language.Lexicon(model), len(model.languages)
    for i, text in enumerate(texts):
        share = np.zeros(k)
        for chain in language.chains(text):
            rows = [sum(model.weights[s].astype(float) for s in language.features(w)) for w in chain]
            ways = list(itertools.product(range(k), repeat=len(chain)))
            cost = np.array([sum(rows[j][y] for j, y in enumerate(ys)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(ys)) for ys in ways])
            weight = np.exp(cost - cost.max())
            for ys, w in zip(ways, weight / weight.sum(), strict=True):
                for y in ys:
                    share[y] += w
        assert got[i].lang_pred == model.languages[share.argmax()]
        assert abs(got[i].score - share.max() / share.sum()) < 1e-4
    assert len(lexicon.numbers(["ein"])) == 1


def test_long_words_are_one_position(spark, model, monkeypatch):
    word = "straßenbahn" * 7
    assert language.chains(word) == [[word]]
    whole = language.features(word)
    monkeypatch.setattr(language, "PART", 5)
    assert sorted(language.features(word)) == sorted(whole)
    huge = "überraschung" * 100_000
    row = language.identify(spark.createDataFrame([(1, huge)], "doc_id long, text string"), model).first()
    assert row.lang_pred == "de"


def test_tagged_words(spark, model):
    rows = [(1, "Der Hund schläft unter dem Baum, le chat mange dans la maison."), (2, None), (3, "12 !"), (None, "der die das")]
    got = {r.doc_id: r.words for r in language.tag_words(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [rows[0][1][w.start : w.end] for w in got[1]] == "Der Hund schläft unter dem Baum le chat mange dans la maison".split()
    assert [w.lang for w in got[1]].count("de") >= 4 and [w.lang for w in got[1]].count("fr") >= 4
    assert got[2] == [] == got[3] and len(got[None]) == 3
    assert all(0 <= w.probability <= 1 for w in got[1])
    assert language.tag_words(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_filter_edges(spark, model):
    rows = [(1, None, "a"), (2, "", None), (3, "der hund und die katze sind im garten", "b"), (3, "der hund und die katze sind im garten", "b"), (None, "der mann und die frau sind im haus", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    kept = language.in_known_language(df, model)
    assert kept.schema == df.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[2:], key=str)
    assert language.in_known_language(df.limit(0), model).count() == 0
    assert language.in_known_language(df, language.Model()).count() == 0


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !? ½ _"), (None, "der die das und"), (5, "der die das und " * 40_000), (5, "日本語 " * 3)]
    df = spark.createDataFrame([(i, t, "xx", 0) for i, t in rows], "doc_id long, text string, lang_pred string, score int")
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(df, model).collect()}
    assert got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == 0
    assert got[(None, "de")] > 0.5 and got[(5, "de")] > 0.9
    assert len(got) == 6
    assert language.identify(df.limit(0), model).count() == 0


def test_nothing_to_learn(spark, docs):
    for some, want in ((docs.limit(0), {"und"}), (docs.where("lang = 'fr'").limit(30), {"fr"})):
        got = {r.lang_pred for r in language.identify(docs.limit(20), language.fit(some)).collect()}
        assert got == want


def invented(rng, lang, words):
    """Words of a made-up language with syllables of its own."""
    own = np.random.default_rng(1000 + lang)
    syllables = ["".join(own.choice(list("bcdfghklmnprstvz"), 1)) + "".join(own.choice(list("aeiouyäöü"), 2)) for _ in range(12)]
    return ["".join(rng.choice(syllables, rng.integers(2, 4))) for _ in range(words)]


def test_every_language_is_learned(spark):
    """Languages beyond the most frequent 64 are learned as well."""
    rng, rows = np.random.default_rng(7), []
    for lang in range(70):
        for _ in range(12 if lang < 64 else 8):
            rows.append((len(rows), f"l{lang:02}", " ".join(invented(rng, lang, 60))))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit(df)
    assert model.languages == [f"l{k:02}" for k in range(70)]
    fresh = spark.createDataFrame([(k, " ".join(invented(rng, k, 60))) for k in range(70)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(fresh, model).collect()}
    assert all(got[k] == f"l{k:02}" for k in range(64, 70))
    assert sum(got[k] == f"l{k:02}" for k in range(70)) > 66


def test_short_lines_of_one_language_leave_room_for_others(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"l{i // 20}", "\n".join(invented(rng, i // 20, 1500))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartitionByRange(2, "lang")
    model = language.fit(df, sample=1)
    fresh = spark.createDataFrame([(k, " ".join(invented(rng, k, 60))) for k in range(2)], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in language.identify(fresh, model).collect()) == [(0, "l0"), (1, "l1")]


def test_copies_of_one_id_take_one_place(spark, docs):
    """A row that is repeated many times neither fills the sample nor changes the model."""
    some = docs.where("n_chars < 2000").select("doc_id", "lang", "text").limit(60)
    one = some.where(~held_out(F.col("doc_id"))).orderBy("doc_id").limit(1)
    more = some.unionByName(one.crossJoin(spark.range(500)).drop("id"))
    a, b = language.fit(some, sample=10), language.fit(more, sample=10)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_blocks_of_chains_change_nothing(monkeypatch):
    rng = np.random.default_rng(9)
    lines = [(f"l{k}", invented(rng, k, int(n))) for k in range(3) for n in rng.integers(1, 30, 20)]
    whole = language.train(lines, ["l0", "l1", "l2"])
    texts = [" ".join(w) for _, w in lines]
    want = language.predict(texts, whole, language.Lexicon(whole))
    monkeypatch.setattr(language, "TRAIN_CELLS", 60)
    monkeypatch.setattr(language, "CELLS", 60)
    parts = language.train(lines, ["l0", "l1", "l2"])
    got = language.predict(texts, parts, language.Lexicon(parts))
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and got[0] == want[0] and np.allclose(got[1], want[1], atol=1e-4)


def test_foreign_and_random_texts_go_and_clean_ones_stay(spark, docs, model):
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    greek = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα"
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах"
    rng = np.random.default_rng(10)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10))) for _ in range(300))
    clean = docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 100)).select("doc_id", "text")
    df = clean.unionByName(spark.createDataFrame([(-1, polish), (-2, greek), (-3, noise), (-4, russian), (-5, "日本語 " * 30), (-6, "wkwkw qkwq wwkq " * 40)], "doc_id long, text string"))
    kept = {r.doc_id for r in language.in_known_language(df, model).collect()}
    assert not kept & {-1, -2, -3, -4, -5, -6}
    assert kept == {r.doc_id for r in clean.collect()}


def made_up(seed, documents, own=None):
    """A language of its own syllables: words and documents of it."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = own or ["".join(rng.choice(x) for x in (letters, "aeiouy", rng.choice([letters, [""]]))) for _ in range(30)]
    words = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(4000)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 80))) for _ in range(documents)]


def test_thirty_languages_do_not_make_gibberish_familiar(spark):
    """With thirty learned languages foreign and random texts still go, and clean texts, mixed ones too, stay."""
    learned = {f"l{k:02}": made_up(k, 60) for k in range(30)}
    lines = [(lang, t.split()) for lang, texts in learned.items() for t in texts[:40]]
    model = language.train(lines + language.joined(lines), sorted(learned))
    rng = random.Random(99)
    clean = [t for texts in learned.values() for t in texts[40:]]
    mixed = ["\n".join(rng.sample(clean, 2)) for _ in range(30)]
    foreign = [t for k in range(100, 110) for t in made_up(k, 10)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(50)) for _ in range(100)]
    rows = [(i, t, kind) for i, (t, kind) in enumerate([(t, "clean") for t in clean] + [(t, "mixed") for t in mixed] + [(t, "foreign") for t in foreign] + [(t, "noise") for t in noise])]
    kept = language.in_known_language(spark.createDataFrame(rows, "doc_id long, text string, kind string"), model, least=0.3).groupBy("kind").count().collect()
    kept = {r["kind"]: r["count"] for r in kept}
    assert kept["clean"] >= 0.99 * len(clean) and kept["mixed"] >= 0.99 * len(mixed)
    assert kept.get("foreign", 0) <= 0.05 * len(foreign) and kept.get("noise", 0) <= 0.05 * len(noise)

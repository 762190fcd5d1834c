"""The piece transducer against the library, and exact round trips."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import pieces

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    return pieces.Pieces(MODEL)


ODD = [
    "", " ", "  a  b ", "\n\t a", "ﬁ Ａ é", "▁a", "a▁ b", "<0x41>", "<s>a</s>", "​ x", "日本語", "\x00a", "a\r\nb", "😀👩‍👩‍👧 ok", "    if x == 10:\n        return f(x)\n",
    *(c * k for c in (" ", "=", "/", "a", "-") for k in range(1, 60)), *(" " * k + "日" for k in range(40)), "x" * 3000, "é" * 500 + " " * 500,
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(machine, library, text):
    ids = library.encode(text)
    assert machine.encode(text).tolist() == ids
    assert machine.decode(ids) == library.decode(ids)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" =/-_.(){}0123abetionsrg日é▁\n"), st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=40))
def test_any_text(machine, library, text):
    ids = machine.encode(text).tolist()
    assert ids == library.encode(text)
    assert machine.decode(ids) == text.replace("▁", " ")


def cheapest(machine, text):
    """Ids of the path of least cost, by listing every way to write a text as pieces and bytes."""
    text = (machine.prefix + text).replace(" ", "▁")
    paths = [((), 0.0, 0)]  # ids, cost, position
    done = []
    while paths:
        ids, cost, at = paths.pop()
        if at == len(text):
            done.append((cost, ids))
            continue
        if text[at] not in machine.id:
            b = text[at].encode()
            paths.append((ids + tuple(machine.byte[x] for x in b), cost + pieces.BYTE * len(b), at + 1))
        for end in range(at + 1, len(text) + 1):
            p = text[at:end]
            if p in machine.id:
                before = machine.text[ids[-1]] if ids and ids[-1] in machine.id.values() else None
                if machine.stands(before, p) if before else machine.stands(p):
                    paths.append((ids + (machine.id[p],), cost - machine.score[p], end))
    return list(min(done)[1])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(" abetinsrg日é▁\n"), min_size=1, max_size=7))
def test_shortest_path_of_all(machine, library, text):
    assert machine.encode(text).tolist() == cheapest(machine, text) == library.encode(text)


def test_costs_decide(monkeypatch):
    """Where the pair machine lets every pair pass, the path with the least sum of costs is taken."""
    free = pieces.Pieces(MODEL)
    free.pairs = type("Free", (dict,), {"__missing__": lambda self, key: 0.0, "cost": lambda self, key: 0.0})()
    monkeypatch.setattr(free, "stands", lambda *a: True)
    for text in ("the", "in a", "bat", "é日"):
        want = cheapest(free, text)
        assert free.encode(text).tolist() == want
        assert np.frombuffer(free.compose(free.prefix + text), np.uint16).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" =/-.0abetinsrgé▁"), min_size=1, max_size=30), min_size=1, max_size=8, unique=True))
def test_segments_composed_together(machine, segments):
    assert machine.compose_many(segments) == [machine.compose(x) for x in segments]


def test_few_pairs_are_kept(library, monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 40)
    monkeypatch.setattr(pieces, "TOGETHER", 3)
    small = pieces.Pieces(MODEL)
    texts = ["the cat sat on the mat and the dog", "ein Hund und eine Katze im Garten", "", "日本 and é"]
    assert [x.tolist() for x in small.encode_all(texts)] == library.encode(texts)


@given(st.lists(st.integers(0, 2**40), unique=True, max_size=200), st.lists(st.integers(0, 2**40), max_size=50))
def test_number_table(keys, others):
    table, half = pieces.Table(4), len(keys) // 2
    for part in (keys[:half], keys[half:]):
        table.add(np.array(part, np.int64), np.array([k % 1000 for k in part], np.int32))
    asked = keys + others
    held = set(keys)
    assert table.get(np.array(asked, np.int64)).tolist() == [k % 1000 if k in held else -1 for k in asked]


@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decoding_any_ids(machine, ids):
    assert isinstance(machine.decode(ids), str)


def test_documents(machine, library, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert [machine.encode(t).tolist() for t in texts] == library.encode(texts)


def test_table(spark, library):
    rng = random.Random(2)
    texts = [None, "", "a b", "a b", "".join(rng.choice("abc dé\n") for _ in range(200_000))]
    df = spark.createDataFrame([(i if i != 2 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(pieces.decode(pieces.encode(df, MODEL), MODEL).collect(), key=lambda r: str(r.text))
    for r, t in zip(got, sorted(texts, key=str), strict=True):
        assert r.text == t == r.decoded
        assert (r.ids is None) == (t is None)
        if t is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(t)
    assert pieces.decode(pieces.encode(df.limit(0), MODEL), MODEL).count() == 0


def test_query_takes_one_worker_a_task(spark):
    """Each Python pass of a stage takes a worker of its own in every task, with a machine and its segments."""
    from quillstone.llm import queries

    plan = queries.op8_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_both_ways_is_one_after_the_other(spark):
    rows = [(1, None), (2, ""), (None, "a▁ b\n日本 é"), (4, "the cat"), (4, "the cat"), (5, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at_once, apart = pieces.both_ways(df, MODEL), pieces.decode(pieces.encode(df, MODEL), MODEL)
    assert at_once.schema == apart.schema
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, apart.collect()))
    assert pieces.both_ways(df.limit(0), MODEL).count() == 0


def test_number_table_is_not_sparse():
    table = pieces.Table(4)
    for at in range(0, 10_000, 100):
        table.add(np.arange(at, at + 100), np.zeros(100, np.int32))
        assert 2 * table.n <= len(table.keys) <= 4 * table.n

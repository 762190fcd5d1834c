"""Token counts and packing against the tokenizer library itself."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quillstone.llm import bpe, packing

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [
    "", None, " ", "a<|endoftext|>b<|endoftext|>", "  x\n\n y\t　z", "it's we'LL 'd 's", "ñandú café 日本語 한국어 😀👩‍👩‍👧",
    "a" * 700, " " * 50 + "x", "\x1c\x1d x\x85y​", "١٢٣ ½ Ⅷ", "é combining", "word " * 3000, "word " * 3000, "x" * 3 + "\n" * 1024,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "other", 1.0) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, n_tokens string, key double")


def test_counts_equal_the_library(spark, docs, library):
    got = sorted((tuple(r) for r in bpe.count_tokens(docs, JSON).collect()), key=str)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = [(d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for d, t in texts]
    assert got == sorted(want, key=str)


def test_long_texts_are_counted_whole(library):
    text = "word, 12 ñ " * 90_000
    assert bpe.count_text(text, JSON) == len(library.encode(text, add_special_tokens=False).ids)


def test_cache_generations_keep_counts(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    counts = bpe._Counts(bpe.MergeTable(JSON))
    words = ["alpha", " beta", " gamma", " delta", "alpha", " epsilon", " beta"] * 3
    assert [counts[w] for w in words] == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_curve_visits_every_cell_by_single_steps():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    index = packing.hilbert_index(points, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_pieces_cover_every_id_once(spark, docs, library):
    rows = packing.pack(docs, JSON, RANKS, 64).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(ODD)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {None if i == 3 else i for i in ids}
    for doc, pieces in by_doc.items():
        own = ids[3 if doc is None else doc]
        copies = 2 if doc == len(ODD) - 1 else 1
        assert all(p.doc_tokens == len(own) for p in pieces)
        assert sorted(k for p in pieces for k in range(p.start, p.start + p.length)) == sorted([*range(len(own))] * copies)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64 and end & (end - 1) == 0


def test_empty_table(spark, docs):
    assert packing.pack(docs.limit(0), JSON, RANKS).count() == 0
    assert bpe.count_tokens(docs.limit(0), JSON).count() == 0

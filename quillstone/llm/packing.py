"""Packing of documents into token sequences along a space-filling curve.

1. Each task encodes its documents and projects their hashed token vectors to three dimensions;
   the Hilbert index of the quantised point is the document's key. Ids, compressed, and keys are
   written to the shared folder, so nothing is encoded twice.
2. Spark range-partitions the documents by (key, doc_id): documents with like tokens become
   neighbours. The second column splits ties, so a group of copies of any size spreads over as
   many partitions as its share asks for.
3. Each partition lays its documents end to end and cuts the stream every `length` ids. Its last,
   shorter sequence is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import shuffle_width, slices, staged

#: Dimensions of the projection, and bits for each of them in the key.
DIMENSIONS, BITS = 3, 10
#: Ids in a partition, about.
PARTITION = 1 << 24
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of `points` (integers below 2**bits).

    Neighbours on the curve are neighbours in space: consecutive positions differ by one in
    exactly one coordinate. All rows advance together, bit by bit from the highest.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    # undo excess work from the top bit down: reflect or exchange the low bits of each axis with the first
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            high = (x[d] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    # Gray code across the axes
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[dims - 1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    # interleave, highest bits first
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[d] >> b) & 1
    return out


@functools.cache
def projection() -> np.ndarray:
    """A fixed pseudo-random weight for each 16-bit id and dimension, of mean 0 and variance 1."""
    z = np.arange(65536 * DIMENSIONS, dtype=np.uint64) + np.uint64(1)
    z *= np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    unit = ((z ^ z >> np.uint64(31)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
    return ((unit - np.float32(0.5)) * np.float32(12**0.5)).reshape(65536, DIMENSIONS)


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie end to end in `ids`; a document without ids has key 0.

    The vector of a document holds the counts of its ids. The projected mean, scaled by the
    root of the length, is roughly normal; a logistic curve spreads it over the grid.
    """
    sums = np.zeros((len(lengths), DIMENSIONS), np.float32)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
        weights = projection()
        for d in range(DIMENSIONS):
            sums[full, d] = np.add.reduceat(weights[:, d][ids], starts)
    scaled = sums / np.sqrt(np.maximum(lengths, 1))[:, None] / 4
    grid = np.minimum((1 << BITS) / (1 + np.exp(-np.clip(scaled, -30, 30))), (1 << BITS) - 1)
    return np.where(lengths > 0, hilbert_index(grid.astype(np.int64), BITS), 0)


def encoded(docs: DataFrame, vocabulary: str, ranks: str, end_id: int) -> DataFrame:
    """Per document: doc_id, key, n (ids with the end id), ids (compressed 16-bit numbers)."""

    def run(batches):
        table = bpe.ids_of(vocabulary, ranks)
        squeeze, end = zstandard.ZstdCompressor(level=1), bpe.pack([end_id])
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            packed = [table.encode(t) if t else b"" for t in texts]
            n = np.array([len(p) // 2 for p in packed])
            keys = curve_keys(np.frombuffer(b"".join(packed), "<u2"), n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys), pa.array(n + 1), pa.array([squeeze.compress(p + end) for p in packed], pa.binary())],
                names=["doc_id", "key", "n", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, n long, ids binary")


class _Open:
    """Pieces of the stream that no sequence has taken yet: fewer ids than one sequence holds."""

    def __init__(self, length: int, first_id: int):
        self.length, self.next_id, self.held, self.parts = length, first_id, 0, []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while at < total:
            take = min(total - at, self.length - self.held)
            self.parts.append((doc_id, at, ids[at : at + take], total))
            self.held, at = self.held + take, at + take
            if self.held == self.length:
                self.close(self.length)

    def close(self, size: int) -> None:
        """Make one sequence of the first `size` ids held."""
        offset = 0
        while offset < size:
            doc_id, start, ids, total = self.parts.pop(0)
            if len(ids) > size - offset:
                cut = size - offset
                self.parts.insert(0, (doc_id, start + cut, ids[cut:], total))
                ids = ids[:cut]
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.held -= size
        self.next_id += 1

    def close_all(self) -> None:
        while self.held:
            self.close(1 << self.held.bit_length() - 1)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, vocabulary: str, ranks: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Lay all documents, each closed by `end_id`, into sequences of at most `length` ids.

    One row for each piece: doc_id, start (ids of the document before it), length, ids_crc32 (of
    the ids as unsigned little-endian 32-bit numbers), doc_tokens (with the end id), sequence_id
    (unique, not gapless) and offset in the sequence. Each sequence has `length` ids or a power
    of two. A null or empty text is a document of the end id alone; a null doc_id stays null;
    repeated rows are packed once each; an empty table gives no rows; other columns are not read.
    A text longer than a sequence runs through as many as it needs.
    """
    spark = docs.sparkSession
    stored = staged(encoded(docs, vocabulary, ranks, end_id))

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        seqs = _Open(length, TaskContext.get().partitionId() << 40)
        for b in batches:
            for doc_id, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seqs.add(doc_id, np.frombuffer(opener.decompress(packed.as_buffer()), "<u2"))
                if len(seqs.rows) >= 20_000:
                    yield seqs.batch()
        seqs.close_all()
        yield seqs.batch()

    # partitions of a bounded number of ids, however large the input; no fewer than the session deals to
    ids = stored.agg(F.sum("n")).first()[0] or 0
    width = max(shuffle_width(spark), -(-ids // PARTITION))
    ordered = stored.repartitionByRange(width, "key", "doc_id").sortWithinPartitions("key", "doc_id", "n", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(run, PIECES)

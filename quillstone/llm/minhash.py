"""Near duplicates by circulant MinHash, banding and exact verification.

1. Signatures. The shingles of a text are places in a ring of 2**32. One permutation scatters them;
   coordinate k is the least value of a second permutation over the scattered places, shifted
   round the ring by k. Two permutations give all coordinates (the shift stands for a permutation
   of its own), so a signature takes five cheap passes a coordinate over numbers in cache.
2. Bands. Coordinates are hashed in bands of ROWS; sets that agree in a band meet in its bucket.
3. Verification. Copies with one set are one node. Nodes of a bucket meet pivots of it, and every
   link is confirmed on the two whole sets. Links make components.
4. The rest of crowded buckets. Nodes that share a bucket but not a component yet are compared
   exactly, without listing their pairs: they are told apart by a prefix of their rarest shingles
   and the token-group matrix of `jaccard`.

A pair of similarity s shares no bucket with probability (1 - s ** ROWS) ** BANDS: 7e-9 for the asked
0.85, and less for every pair above it. Nothing else loses a link: buckets and partners have no cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import PREFIX, _Hashes, by_document, connected, few, node_id, sets, shingles, surveyed
from .shared import dealt_join, slices, staged

BANDS, ROWS = 32, 5
#: Shingles that are permuted at once, so that they stay in cache.
PIECE = 1 << 14
#: Odd multipliers of the two permutations, and of the hash of a band.
SCATTER, ORDER = (0x7FEB352D, 0x846CA68B), (0x85EBCA6B, 0xC2B2AE35)
BAND = np.uint64(0x9E3779B97F4A7C15)
#: Slack of (bucket, node) rows: sharing a bucket says nothing of the places of shingles.
ANY = 1 << 50
SURVEY = "doc_id long, h long, node long, n long, bands array<long>"


def permuted(x: np.ndarray, by: tuple[int, int], spare: np.ndarray) -> np.ndarray:
    """A permutation of the numbers below 2**32, in place: shifts and products that can be undone."""
    for shift, factor in ((16, by[0]), (13, by[1]), (16, 1)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor > 1:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def signatures(found: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of `size` coordinates for each non-empty array of 64-bit shingle hashes."""
    pieces = [(i, s[at : at + PIECE]) for i, s in enumerate(found) for at in range(0, len(s), PIECE)]
    owner = np.array([i for i, _ in pieces], np.int64)
    least = np.empty((len(pieces), size), np.uint32)
    first = 0
    while first < len(pieces):
        last, total = first, 0
        while last < len(pieces) and total + len(pieces[last][1]) <= 2 * PIECE:
            total += len(pieces[last][1])
            last += 1
        part = [s for _, s in pieces[first:last]]
        starts = np.cumsum([0] + [len(s) for s in part[:-1]])
        places = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        spare, shifted = np.empty_like(places), np.empty_like(places)
        permuted(places, SCATTER, spare)
        for k in range(size):
            np.subtract(places, np.uint32(k), out=shifted)
            least[first:last, k] = np.minimum.reduceat(permuted(shifted, ORDER, spare), starts)
        first = last
    return np.minimum.reduceat(least, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)


def buckets(found: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The bucket of every band, as 64-bit numbers; one row for each set."""
    parts = signatures(found, bands * rows).reshape(len(found), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * BAND, (len(found), bands)).copy()
    for r in range(rows):
        total = (total ^ parts[:, :, r]) * BAND
        total ^= total >> np.uint64(29)
    return (total * BAND).view(np.int64)


def signed(docs: DataFrame, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, h (hash of the text), node (hash of its set; null for an empty one), n (its size) and bands.

    Of documents with one set that are read together, one has the buckets.
    """

    def run(batches):
        hashes = _Hashes()
        for b in slices(batches):
            ids, texts, h = (b.column(i) for i in range(3))
            nodes: list[int | None] = []
            sizes, kept, first = [], {}, []
            for text in texts.to_pylist():
                s = shingles(text, hashes, words) if text else np.zeros(0, np.uint64)
                node = node_id(s) if len(s) else None
                first.append(node is not None and node not in kept)
                if first[-1]:
                    kept[node] = s
                nodes.append(node)
                sizes.append(len(s))
            flat = buckets([*kept.values()], bands, rows).reshape(-1) if kept else np.zeros(0, np.int64)
            ends = np.cumsum([0, *first]) * bands
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([not x for x in first]))
            known = pa.array([x is None for x in nodes])
            node = pa.array(np.array([x or 0 for x in nodes], np.uint64).view(np.int64), mask=known.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids, h, node, pa.array(sizes, pa.int64()), lists], names=["doc_id", "h", "node", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, SURVEY)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id and kept (it has the smallest id of its component).

    Two documents link when 100 * overlap >= percent * union of their shingle sets, which is
    confirmed on whole sets; component_id is the smallest doc_id that links reach, the document's
    own included. A null or empty text, or one without words, has no shingles and is alone. A null
    doc_id stays null, is never the smallest, and gets null only if no other id is reached (kept is
    then true); repeated rows each keep their row; an empty table gives no rows; other columns are
    not read.
    """
    own = staged(signed(docs, words, bands, rows))
    met = own.where("bands is not null").select(F.explode("bands").alias("shingle"), "node", "n")
    busy = met.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("shingle")
    held = staged(dealt_join(met, staged(busy), "shingle", F.col("node"), "left_semi").distinct().withColumn("slack", F.lit(ANY)))
    least = staged(own.where("node is not null").groupBy("node").agg(F.min("h").alias("h"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    texts = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))

    def of(nodes: DataFrame) -> DataFrame:
        """The texts of these nodes, one hash a node."""
        return texts.join(few(staged(least.join(nodes.select("node").distinct(), "node", "left_semi").select("h").distinct())), "h", "left_semi")

    def narrowed(rest: DataFrame) -> DataFrame:
        return surveyed(of(rest), words, percent).where(F.col("kind") == PREFIX).select("shingle", "node", "n", "slack")

    stored = staged(sets(of(held), words).groupBy("node").agg(F.first("shingles").alias("shingles")))
    found = by_document(own.select("doc_id", "h", "node", "n"), least, connected(held, stored, percent, narrowed))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

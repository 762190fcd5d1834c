"""Exact n-gram Jaccard join by a token-group matrix.

Documents are sets of hashed word shingles; copies with one set are one node. Everything that is
large moves as compressed column blocks, one for each pair of tasks, not as rows.

1. Shared shingles. Nodes send their shingles, dealt by hash, to tasks that keep those held by two
   nodes or more, with the number of holders, and send them back by node.
2. Prefixes. In one global order, rarest shingles first, two sets that are similar enough share a
   shingle among the first `size - needed + 1` of either. Shingles of a single node come first in
   that order and need not be looked at again; most nodes have enough of them to be out of the
   join here. The rest, (shingle, node) rows, are a few per cent of the shingles.
3. Groups. The holders of a shingle are compared with a few pivots among them; links found in this
   way join similar documents into groups, however many copies there are, without listing the
   pairs inside a group.
4. Matrix. Where a shingle's holders still lie in different groups, the (shingle, group) matrix
   gives the groups that each document may have to be compared with. A task holds the union of a
   group's shingles; the document's overlap with the union bounds its overlap with each member,
   and only groups whose bound suffices are opened. Members are compared one by one until one
   links, since one link joins the groups.

No pair with the asked similarity is missed: steps 3 and 4 look at every two holders of every
prefix shingle, or know that they are already connected. Nodes are told apart by 64-bit hashes of
their sets, shingles by 64-bit hashes; equal hashes of different ones are taken as equal: among n
sets, n * n / 2**65 such pairs are to be expected (0.03 for 10**9, 3 for 10**10). Steps 1 to 3
look for candidates by the upper 48 bits of a shingle's hash, which can only add candidates.

One pass over the texts gives the sets' sizes and the shingles of step 1; the texts of the few
nodes that are left after step 2 are read once more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Kept
from .shared import dealt_join, shuffle_width, slices, staged

#: Shingles that a task gathers before it deals them out; nodes in a group of the matrix; queries met at once.
BATCH, GROUP, QUERIES = 2_000_000, 64, 512
#: Bytes of text whose shingles meet in one task; 5 M of them take some 400 MB there.
SLICE = 32 << 20
#: Nodes whose ids are broadcast at most (8 bytes each); beyond it their sets are found by a shuffle.
BROADCAST = 1_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Hashes(Kept):
    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def shingles(text: str, hashes: Kept, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.

    A-Z are lower-cased and words end at ASCII white space; a shorter text is one shingle, and
    one without words has none.
    """
    found = text.encode().lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found) + 1)][: len(found)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):  # a product of its own for each place, so that order counts
        part = h[i : i + n]
        total = (total ^ total >> np.uint64(31)) * _MIX[4] + (part ^ part >> np.uint64(29)) * _MIX[i % 4]
    total ^= total >> np.uint64(32)
    total *= _MIX[3]
    return np.unique(total ^ total >> np.uint64(29))


def node_id(shingle_set: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingle_set.tobytes())


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns as one compressed string; bytes of one weight lie together, which packs better."""
    parts = [np.array([len(columns), *(x for c in columns for x in (len(c), ord(c.dtype.char)))], np.int64).tobytes()]
    parts += [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(data) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (count,) = np.frombuffer(raw, np.int64, 1)
    heads, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2), 8 + 16 * int(count), []
    for n, char in heads.tolist():
        kind = np.dtype(chr(char))
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """(node, shingles) of every text with words; shingles are packed 64-bit numbers."""

    def run(batches):
        hashes = _Hashes()
        for b in slices(batches):
            kept = {}
            for text in dict.fromkeys(b.column(0).to_pylist()):  # copies once
                if text and len(s := shingles(text, hashes, words)):
                    kept[node_id(s)] = s
            ids = np.array([*kept], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s.tobytes() for s in kept.values()], pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set of the asked similarity."""
    return -(-n.astype(np.int64) * percent // 100)


#: What `surveyed` returns; kind is DOCUMENT or PREFIX.
SURVEY = "kind int, doc_id long, h long, shingle long, node long, n long, slack long"
DOCUMENT, PREFIX = 0, 1


def surveyed(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Two kinds of rows from one pass over the texts.

    DOCUMENT: doc_id, h (hash of the text), node (hash of its set; null for an empty one), n (its
    size). PREFIX: (shingle, node, n, slack), the prefix shingles that two nodes or more hold.

    A pair with the asked similarity shares a shingle among the first `n - overlap + 1` of both,
    where the overlap is that of these two sizes. `slack`, from n and the shingle's place, says so
    for a partner of m shingles: slack >= percent * m.

    Shingles are sent as the upper 48 bits of their hashes. Two that meet there make a set look
    smaller by one: `lost` counts them, and places are lowered by it, so that no link goes.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(shuffle_width(docs.sparkSession), -(-size // SLICE))
    block = "kind int, slice int, block binary"

    def packed(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
            names=["kind", "slice", "block"],
        )

    def dealt(owner: np.ndarray, columns, made) -> pa.RecordBatch:
        """Rows (slice, block) for columns sorted by owner; `made` packs the columns of one slice."""
        bounds = np.searchsorted(owner, np.arange(width + 1))
        return packed(PREFIX, [(s, made(*(c[lo:hi] for c in columns))) for s, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if lo < hi])

    def out(batches):
        hashes = _Hashes()
        held: dict[int, np.ndarray] = {}
        seen: list[tuple] = []
        size = made_blocks = 0

        def shared():
            ids, sizes = np.array([*held], np.uint64), np.array([len(s) for s in held.values()], np.uint32)
            tokens = np.concatenate([*held.values()]) >> np.uint64(16)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            same = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
            lost = np.bincount(owner[1:][same], minlength=len(ids)).astype(np.uint32)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]

            def made(t, o):
                present, local = np.unique(o, return_inverse=True)
                return squeeze(_deltas(t), local.astype(np.uint16 if len(present) < 1 << 16 else np.uint32), ids[present], sizes[present], lost[present])

            return dealt((tokens >> np.uint64(16)) * np.uint64(width) >> np.uint64(32), (tokens, owner), made)

        def documents():
            nonlocal made_blocks
            made_blocks += 1
            ids, h, nodes, n = zip(*seen, strict=True)
            known = np.array([i is not None for i in ids], np.uint8)
            columns = np.array([i or 0 for i in ids], np.int64), known, np.array(h, np.int64), np.array(nodes, np.uint64), np.array(n, np.uint32)
            return packed(DOCUMENT, [((TaskContext.get().partitionId() + made_blocks) % width, squeeze(*columns))])

        for b in slices(batches):
            for doc_id, text, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingles(text, hashes, words) if text else np.zeros(0, np.uint64)
                k = node_id(s) if len(s) else 0
                seen.append((doc_id, h, k, len(s)))
                if len(s) and k not in held:
                    held[k] = s
                    size += len(s)
            if size >= BATCH or len(seen) >= BATCH // 20:
                if held:
                    yield shared()
                yield documents()
                held, seen, size = {}, [], 0
        if held:
            yield shared()
        if seen:
            yield documents()

    def opened_blocks(batches, blocks: list[list[np.ndarray]]):
        """Document blocks as they come; the columns of others go to `blocks`."""
        for b in batches:
            for kind, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == DOCUMENT:
                    yield s, x
                else:
                    blocks.append(unsqueeze(x.as_buffer()))

    def back(batches):
        blocks: list[list[np.ndarray]] = []
        for s, x in opened_blocks(batches, blocks):
            yield packed(DOCUMENT, [(s, x.as_py())])
        if not blocks:
            return
        token = np.concatenate([_sums(t) for t, *_ in blocks])
        node, n, lost = (np.concatenate([x[i][x[1]] for x in blocks]) for i in (2, 3, 4))
        blocks.clear()
        order = np.lexsort((node, token))
        token, node, n, lost = token[order], node[order], n[order], lost[order]
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])  # a node once
        token, node, n, lost = token[first], node[first], n[first], lost[first]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        holders = np.diff(np.append(starts, len(token)))
        each = np.repeat(holders, holders).astype(np.uint32)
        shared = each > 1
        columns = [c[shared] for c in (token, node, n, lost, each)]
        order = np.argsort(columns[1], kind="stable")
        columns = [c[order] for c in columns]
        yield dealt((columns[1] >> np.uint64(32)) * np.uint64(width) >> np.uint64(32), columns, squeeze)

    def rows(kind: int, **columns) -> pa.RecordBatch:
        size = len(columns["node"])
        names = [f.split()[0] for f in SURVEY.split(", ")]
        filled = [pa.array([kind] * size, pa.int32()) if c == "kind" else columns[c] if c in columns else pa.nulls(size, pa.int64()) for c in names]
        return pa.RecordBatch.from_arrays(filled, names=names)

    def chosen(batches):
        blocks: list[list[np.ndarray]] = []
        for _, x in opened_blocks(batches, blocks):
            ids, known, h, node, n = unsqueeze(x.as_buffer())
            yield rows(DOCUMENT, doc_id=pa.array(ids, mask=known == 0), h=pa.array(h), node=pa.array(node.astype(np.int64), mask=n == 0), n=pa.array(n.astype(np.int64)))
        if not blocks:
            return
        token, node, n, lost, holders = (np.concatenate(c) for c in zip(*blocks, strict=True))
        blocks.clear()
        order = np.lexsort((token, holders, node))
        token, node, n, lost = token[order], node[order], n[order].astype(np.int64), lost[order]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        counts = np.diff(np.append(starts, len(node)))
        place = np.arange(len(node)) - np.repeat(starts, counts)
        # the shingles of a single node come first; least overlap of n and m: percent * (n + m) / (100 + percent)
        place += n - lost - np.repeat(counts, counts)
        kept = place <= n - needed(n, percent)
        slack = 100 * n - (100 + percent) * place
        for at in range(0, len(kept), 1 << 18):
            k = kept[at : at + (1 << 18)]
            cut = [pa.array(c[at : at + (1 << 18)][k].astype(np.int64)) for c in (token, node, n, slack)]
            yield rows(PREFIX, **dict(zip(("shingle", "node", "n", "slack"), cut, strict=True)))

    sent = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(out, block).repartitionById(width, F.col("slice"))
    returned = sent.mapInArrow(back, block).repartitionById(width, F.col("slice"))
    return returned.mapInArrow(chosen, SURVEY)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * overlap >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Those of the staged (a, b) pairs whose sets are similar."""

    def run(batches):
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok, pa.bool_())), b.filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    one = stored.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    two = stored.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    halves = dealt_join(pairs, one, "a", F.col("b"))
    # the same rows as pairs, so their frequent keys are found there
    return dealt_join(halves, two, "b", F.col("a"), counted=pairs).select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the (a, b) links; one label for all nodes that links connect.

    Each round a label joins the smallest of its neighbours and links between joined labels go.
    Labels are hashes, so chains of ever smaller neighbours are short and few rounds are needed.
    """
    edges, steps = links, []
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("parent")))
        steps.append(parents)
        left = parents.select("a", F.col("parent").alias("x"))
        right = parents.select(F.col("a").alias("b"), F.col("parent").alias("y"))
        ends = dealt_join(dealt_join(edges, left, "a", F.col("b")), right, "b", F.col("a"), counted=edges)
        edges = staged(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            break
    # later rounds move fewer labels, so theirs are put together first
    while len(steps) > 1:
        last, before = steps.pop(), steps.pop()
        moved = dealt_join(before, last.select(F.col("a").alias("parent"), F.col("parent").alias("label")), "parent", F.col("a"), "left")
        steps.append(moved.select("a", F.coalesce("label", "parent").alias("parent")))
    return staged(steps[0].select(F.col("a").alias("node"), F.col("parent").alias("label")))


def pivot_pairs(held: DataFrame, seed: int, percent: int, vary: bool = False) -> DataFrame:
    """(a, b) pairs of each (shingle, node, n, slack, label) row's node with pivots among the shingle's holders.

    Pivots are the holder with the smallest hash, and that among holders of like size. With `vary`
    the hash depends on the shingle, so that a node meets many pivots of one group. Pairs whose
    sizes or places rule a link out, or that are connected already, are left out.
    """
    by = held.withColumn("class", F.floor(F.log("n") / F.log(F.lit(4 / 3)))).withColumn("h", F.struct(F.xxhash64("node", F.lit(seed), *["shingle"] * vary).alias("h"), "node", "n", "slack", "label"))
    classes = by.groupBy("shingle", "class").agg(F.min("h").alias("own"))
    whole = classes.groupBy("shingle").agg(F.min("own").alias("all"))
    pivots = classes.join(whole, "shingle").select("shingle", "class", F.explode(F.array_distinct(F.array("own", "all"))).alias("pivot"))
    pairs = dealt_join(by, pivots, ["shingle", "class"], F.col("node")).where(
        (F.col("pivot.node") != F.col("node")) & (F.col("pivot.label") != F.col("label"))
        & (F.least("n", "pivot.n") * 100 >= F.greatest("n", "pivot.n") * percent)
        & (F.col("slack") >= F.col("pivot.n") * percent) & (F.col("pivot.slack") >= F.col("n") * percent)
    )
    return pairs.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()


def unsettled(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(shingle, node, n, slack, label) of the shingles whose holders lie in two groups or more."""
    named = held.select("shingle", "node", "n", "slack").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return dealt_join(named, split.select("shingle"), "shingle", F.col("node"), "left_semi", counted=held).select("shingle", "node", "n", "slack", "label")


def opened(rest: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups, by the token-group matrix over staged unsettled rows."""
    members = staged(rest.select("node", "n", "label").distinct())
    sizes = members.groupBy("label").agg(F.count("*").alias("size"))
    held = dealt_join(rest, sizes, "label", F.col("node"))
    chunk = F.pmod(F.xxhash64("node", F.lit("group")), F.ceil(F.col("size") / GROUP).cast("long"))
    members = staged(dealt_join(members, sizes, "label", F.col("node")).select("node", F.struct("size", "label", chunk.alias("chunk")).alias("group")))
    # members of the smaller component ask, so that few documents meet the parts of a large one;
    # a cell holds what a query must reach: the members' least size, and most slack at this shingle
    matrix = held.select("shingle", "node", "n", "slack").join(members, "node")
    matrix = matrix.groupBy("shingle", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("slack").alias("most"))
    asked = dealt_join(held, matrix, "shingle", F.col("node"), counted=rest).where(
        "(size < group.size OR size = group.size AND label < group.label) AND 100 * n >= {p} * low AND 100 * high >= {p} * n "
        "AND slack >= {p} * low AND most >= {p} * n".format(p=percent)
    )
    asked = staged(asked.select("node", "group").distinct())
    # queries of a group meet it in batches of QUERIES or so
    counts = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("parts"))
    asked = staged(dealt_join(asked, counts, "group", F.col("node")).withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))))
    parts = asked.select("group", "part").distinct()
    queries = asked.select("node", "group", "part").join(stored, "node")
    groups = parts.join(members.select("node", "group"), "group").join(stored, "node").select(
        F.col("node").alias("member"), F.col("group").alias("of"), F.col("part").alias("piece"), F.col("shingles").alias("own")
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        own = [(int(k), np.frombuffer(s, np.uint64)) for k, s in zip(left["member"], left["own"], strict=True)]
        if own:
            union = np.unique(np.concatenate([s for _, s in own]))
            for k, s in zip(right["node"], right["shingles"], strict=True):
                q = np.frombuffer(s, np.uint64)
                at = np.searchsorted(union, q)
                at[at == len(union)] = 0
                if 100 * int((union[at] == q).sum()) >= percent * len(q):  # no member can overlap more
                    linked = next((m for m, t in own if similar(q, t, percent)), None)
                    if linked is not None:
                        found.append((min(int(k), linked), max(int(k), linked)))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return groups.groupBy("of", "piece").cogroup(queries.groupBy("group", "part")).applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set) and component_id.

    Two documents link when 100 * overlap >= percent * union of their shingle sets; component_id
    is the smallest doc_id that links reach, the document's own included. A null or empty text, or
    one without words, has no shingles and is alone. A null doc_id stays null, is never the
    smallest, and gets null only if no other id is reached; repeated rows each keep their row; an
    empty table gives no rows; other columns are not read. The spread of memory is bounded by
    blocks and groups, not by how often a shingle or a document is repeated.
    """
    survey = staged(surveyed(docs, words, percent), "kind")
    own = survey.where(F.col("kind") == DOCUMENT).select("doc_id", "h", "node", "n")
    held = survey.where(F.col("kind") == PREFIX).select("shingle", "node", "n", "slack")
    busy = held.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("shingle")
    held = staged(dealt_join(held, busy, "shingle", F.col("node"), "left_semi"))
    # one row a node: one of its texts, its smallest id, and how many documents it stands for
    least = staged(own.where("node is not null").groupBy("node").agg(F.min("h").alias("h"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    wanted = least.join(held.select("node").distinct(), "node", "left_semi").select("h").distinct()
    wanted = few(staged(wanted))
    found = sets(docs.select("text").withColumn("h", F.xxhash64("text")).join(wanted, "h", "left_semi"), words)
    stored = staged(found.groupBy("node").agg(F.first("shingles").alias("shingles")))

    return by_document(own, least, connected(held, stored, percent))


def connected(held: DataFrame, stored: DataFrame, percent: int, narrowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, label) of the nodes that links connect, for staged (shingle, node, n, slack) rows: nodes are compared where they share a shingle.

    Holders meet pivots first; what is not settled then meets in the matrix. `narrowed` may give
    other rows for the nodes that come so far, which share a shingle wherever two are similar.
    """
    alone = held.withColumn("label", F.col("node"))
    pairs = staged(reduce(DataFrame.unionByName, [pivot_pairs(alone, seed, percent) for seed in (1, 2)]).distinct())
    links = staged(verified(pairs, stored, percent))
    labels = None
    for step in ("pivots", "matrix"):
        if labels is None:
            labels = components(links) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        rest = staged(unsettled(held, labels))
        if rest.isEmpty():
            break
        if step == "pivots":
            pairs = staged(pivot_pairs(rest, 3, percent, vary=True).unionByName(pivot_pairs(rest, 4, percent, vary=True)).distinct())
            more = staged(verified(pairs, stored, percent))
        else:
            if narrowed is not None:
                rest = staged(unsettled(staged(narrowed(rest)), labels))
            more = staged(opened(rest, stored, percent))
        if not more.isEmpty():
            links = staged(links.unionByName(more))
            labels = None
    return components(links) if labels is None else labels


def by_document(own: DataFrame, least: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the `own` rows (doc_id, h, node, n); `least` has node, its least id and its copies."""
    # a node of one document without links is its own component; the others get the least id of their label
    named = staged(least.join(labels, "node", "left").where("label is not null or copies > 1").select("node", "least", F.coalesce("label", "node").alias("label")))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = staged(dealt_join(named, component, "label", F.col("node")).select("node", "component_id"))
    whole = dealt_join(own, named.withColumn("joined", F.lit(True)), "node", F.struct("doc_id", "h"), "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def few(ids: DataFrame) -> DataFrame:
    """Staged ids, broadcast if there are at most BROADCAST of them; beyond it a join shuffles them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of `docs`, all columns as they are, with one document of each near-duplicate group.

    The document with the group's smallest doc_id stays. Repeated rows of one id and text are one
    document. Rows without a doc_id cannot be told apart and all stay. The ids that go are
    broadcast up to a count of BROADCAST; beyond it the documents are joined by a shuffle.
    """
    near = staged(near_duplicates(docs, words, percent).where("doc_id is not null"))
    gone = staged(near.where("doc_id <> component_id").select("doc_id").distinct())
    repeated = staged(near.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(few(gone), "doc_id", "left_anti")
    if not repeated.isEmpty():
        repeated = few(repeated)
        twice = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(twice)
    return kept.select(*docs.columns)

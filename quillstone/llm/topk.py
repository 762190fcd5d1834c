"""Exact top-k inner-product search by columnar branch and bound.

Vectors are turned into integers and dealt into blocks: a candidate block holds its vectors
vertically, one contiguous row for each dimension. A query goes through a block a few dimensions
at a time, largest query components first: partial scores of all candidates still alive are
added up, and a candidate is dropped as soon as its partial score plus the product of the
remaining norms (the most that its remaining mass can add) stays below the query's k-th best
score so far. Survivors are compacted, so later dimensions touch few columns.

Blocks meet queries in the cells of a grid: a cell gets one group of query blocks and one group of
candidate blocks. Each task deals its blocks to the groups in turn, so groups differ by little. The
queries are copied once for each candidate group and the candidates once for each query group;
only k rows for each query and cell come back. All cells of a query begin with the same floor: its
k-th best score among the FLOOR candidates of largest norm, which every task gets. A task's
candidates are cut into blocks by falling norm, and a block whose largest norm cannot reach a
query's floor is passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Dimensions added up between two prunings; vectors in a block of candidates or queries.
STEP, BLOCK, QUERIES = 16, 8192, 512
#: Vectors in the groups that meet in a cell, about; cells across the candidates at least.
CELL_CANDIDATES, CELL_QUERIES, CELLS = 32_768, 4_096, 12
#: Candidates of largest norm that give a query its first floor.
FLOOR = 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, v) with v = floor(scale * x) for each component; vectors with null or non-finite parts go."""
    x = F.transform(F.col(vector_column), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    bad = lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return vectors.where(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & ~F.exists(F.col(vector_column), bad)).select(
        F.col(id_column).cast("long").alias("id"), x.alias("v")
    )


def _exact(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest number type that holds every partial score of these integers exactly."""
    if not q.size or not c.size:
        return np.float32
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[-1]
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else object


class Block:
    """Candidates of one dimension count in vertical layout, with norms of what each step leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties in score then fall to the smaller id by position
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.floats = self.columns.astype(np.float32)
        self.squares = np.square(self.columns.astype(np.float64))

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int, so_far: list[list[tuple[int, int]]], floors: np.ndarray) -> None:
        """Merge this block's best into `so_far`: for each query its k best (-score, candidate id), sorted.

        Candidates below a query's floor may be left out.
        """
        kind = _exact(queries, self.columns)
        dims, n = self.columns.shape
        if kind is not object and dims:
            reach = np.sqrt(np.square(queries.astype(np.float64)).sum(axis=1)) * math.sqrt(self.squares.sum(axis=0).max(initial=0.0)) + 1
            asked = np.flatnonzero(reach >= floors)
            if not len(asked):
                return
            if len(asked) < len(queries):
                part = [so_far[i] for i in asked]
                self.best(queries[asked], query_ids[asked], k, part, floors[asked])
                for i, top in zip(asked.tolist(), part, strict=True):
                    so_far[i] = top
                return
        # one order for the block: dimensions with the largest mass in queries and candidates first
        mass = np.square(queries.astype(np.float64)).sum(axis=0) * self.squares.sum(axis=1)
        order = np.argsort(-mass, kind="stable")
        columns = (self.floats if kind is np.float32 else self.columns.astype(kind))[order]
        left = np.sqrt(np.cumsum(self.squares[order][::-1], axis=0)[::-1])  # norm of dimensions d to the end
        q = queries[:, order].astype(kind)
        q_left = np.sqrt(np.cumsum(np.square(queries[:, order].astype(np.float64))[:, ::-1], axis=1)[:, ::-1])
        first = q[:, :STEP] @ columns[:STEP]
        for i, query_id in enumerate(query_ids.tolist()):
            top = so_far[i]
            floor = max(float(floors[i]), -top[-1][0] if len(top) == k else -math.inf)
            alive = np.flatnonzero(self.ids != query_id)
            partial = first[i][alive]
            prune = kind is not object
            if prune and floor == -math.inf and len(alive) > 4 * k:
                # exact scores of those that lead after the first step: the k-th is a first floor
                lead = alive[np.argpartition(-partial, k)[: 2 * k]]
                floor = float(np.partition(q[i] @ columns[:, lead], -k)[-k])
            for a in range(STEP, dims, STEP):
                if prune and floor > -math.inf:
                    # the slack of one keeps rounding of the norms from dropping an equal score
                    kept = np.flatnonzero(partial + q_left[i, a] * left[a, alive] + 1 >= floor)
                    if len(kept) < len(alive):
                        alive, partial = alive[kept], partial[kept]
                if not len(alive):
                    break
                partial = partial + q[i, a : a + STEP] @ columns[a : a + STEP, alive]
            if prune and len(alive) > k:
                kept = np.flatnonzero(partial >= max(floor, np.partition(partial, -k)[-k]))
                alive, partial = alive[kept], partial[kept]
            if len(alive):
                own = zip((-partial).tolist(), self.ids[alive].tolist(), strict=True)
                so_far[i] = sorted([*top, *((int(s), c) for s, c in own)])[:k]


def first_floors(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """For each query its k-th best score among these candidates, its own id left out; -inf if they are too few."""
    kind = _exact(queries, vectors) if len(vectors) else object
    if kind is object or len(vectors) < k:
        return np.full(len(queries), -math.inf)
    scores = (queries.astype(kind) @ vectors.astype(kind).T).astype(np.float64)
    scores[query_ids[:, None] == ids[None, :]] = -math.inf
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]


#: Rows gathered before they are cut into blocks by their norm, in blocks.
GATHERED = 4
BLOCKS = "place int, dims long, wide boolean, ids binary, vectors binary, floors binary"


def _blocks(size: int, places: int, floors_of=None):
    """A function for mapInArrow that gathers (id, v) rows into blocks of one dimension count, dealt over `places`."""

    def run(batches):
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId()

        def cut(dims: int):
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            norms = np.square(vectors.astype(np.float64)).sum(axis=1)
            order = np.argsort(-norms, kind="stable")
            for at in range(0, len(ids), size):
                i, v = ids[order[at : at + size]], vectors[order[at : at + size]]
                wide = bool(v.size) and float(np.abs(v.astype(np.float64)).max()) >= 1 << 15
                floors = floors_of(v, i, dims).tobytes() if floors_of else b""
                yield pa.RecordBatch.from_pydict(
                    {"place": pa.array([made % places], pa.int32()), "dims": [dims], "wide": [wide], "ids": [i.tobytes()],
                     "vectors": [v.astype(np.int64 if wide else np.int16).tobytes()], "floors": [floors]}
                )
                made += 1

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                for dims in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == dims)
                    places_of = (ends[own] - dims)[:, None] + np.arange(dims)
                    held.setdefault(dims, []).append((ids[own], flat[places_of]))
                    if sum(len(i) for i, _ in held[dims]) >= GATHERED * size:
                        yield from cut(dims)
        for dims in list(held):
            yield from cut(dims)

    return run


def _opened(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.int64 if row["wide"] else np.int16).astype(np.int64)
    return ids, vectors.reshape(len(ids), row["dims"])


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k best other rows for each row whose id is divisible by `every`.

    Components become floor(scale * x); the score is their inner product, exact in integers (a
    score beyond 64 bits is held at their bound). Columns: query_id, rank from 1, vec_id, score;
    ties go to the smaller vec_id; a query with fewer than k others gets them all. Vectors that
    are null or hold null or non-finite components take no part, nor do null ids; only vectors of
    equal length meet; an empty table gives no rows; other columns are not read. Of repeated ids
    each row is a candidate, a query's own id never; a query is an id with one of its distinct
    vectors, so an id with two vectors has two sets of ranks from 1.
    """
    rows = scaled(vectors, id_column, vector_column, scale)
    asked = rows.where(F.col("id") % every == 0).distinct()
    n = rows.count()
    columns, across = max(CELLS, -(-n // CELL_CANDIDATES)), -(-n // (every * CELL_QUERIES)) or 1
    size = max(1, min(BLOCK, -(-n // columns)))
    whole = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end - 1)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    leading: dict[int, tuple[list, list]] = {}
    for r in rows.orderBy(F.desc(norm), "id", "v").limit(FLOOR).collect():
        ids, held = leading.setdefault(len(r.v), ([], []))
        ids.append(r.id)
        held.append(r.v)

    def floors_of(queries: np.ndarray, query_ids: np.ndarray, dims: int) -> np.ndarray:
        ids, held = leading.get(dims, ([], []))
        return first_floors(queries, query_ids, np.array(ids, np.int64), np.array(held, np.int64).reshape(len(ids), dims), k)

    candidates = rows.mapInArrow(_blocks(size, columns), BLOCKS).withColumnRenamed("place", "column").withColumn("row", whole(across))
    questions = asked.mapInArrow(_blocks(min(QUERIES, max(1, -(-n // (every * across)))), across, floors_of), BLOCKS).withColumnRenamed("place", "row").withColumn("column", whole(columns))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        blocks = [(c["dims"], Block(*_opened(c))) for _, c in left.iterrows()]
        out = []
        for _, row in right.iterrows():
            ids, queries = _opened(row)
            found: list[list] = [[] for _ in ids]
            for dims, block in blocks:
                if dims == row["dims"]:
                    block.best(queries, ids, k, found, np.frombuffer(row["floors"], np.float64))
            keys = [xxhash.xxh3_64_intdigest(q.tobytes()) - (1 << 63) for q in queries]
            out += [(q, key, c, max(_LEAST, min(_MOST, -s))) for q, key, top in zip(ids.tolist(), keys, found, strict=True) for s, c in top]
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"])

    near = candidates.groupBy("row", "column").cogroup(questions.groupBy("row", "column"))
    near = near.applyInPandas(meet, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

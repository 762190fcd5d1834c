"""An index of exemplars that prunes: cells around centres, of which a search opens those that may hold a neighbour.

For a cell with centre c whose members lie within r of it, no member's inner product with q is above
q.c + |q| r. A search first opens the cells of the highest bounds that hold k members together; the
k-th similarity there is the query's floor, and only cells whose bound reaches it are opened after.
The result is that of a comparison with all exemplars. A block of exemplars meets its queries in one matrix
product; similarities of those that may be among the k best are then summed in order, so that equal vectors tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..settings import DEFAULT
from .vectors import checkpointed

#: Cells at most: their centres are broadcast, and a query's bounds are worked out for all of them.
MAX_CELLS = 4_096
#: Exemplars that centres are fitted on, at most; all are put into cells.
SAMPLE = 20_000
#: Exemplars of a cell, on average, and queries that open it, at most about, that one join key brings together.
BLOCK, TURN = 1_024, 16_384
#: Products of a query and an exemplar that are held at once, about.
TILE = 1 << 21


@dataclass
class Index:
    """`exemplars`: exemplar_idx, label, text, embedding, cell, block. `cells`: cell, centre, radius, n, blocks."""

    exemplars: DataFrame
    cells: DataFrame

    def write(self, path: str) -> None:
        self.exemplars.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/exemplars")
        self.cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # at most MAX_CELLS rows

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/exemplars"), spark.read.parquet(f"{path}/cells"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it; tile by tile."""
    cell, distance, squares = np.empty(len(x), np.int32), np.empty(len(x)), np.square(centres).sum(axis=1)
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        cell[i : i + BLOCK] = found = np.argmin(squares - 2 * part @ centres.T, axis=1)
        distance[i : i + BLOCK] = np.sqrt(np.square(part - centres[found]).sum(axis=1))
    return cell, distance


def _fit(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    centres = sample[:cells].copy()
    for _ in range(rounds):
        cell, _ = _nearest_centre(sample, centres)
        n = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def build(bank: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8) -> Index:
    """The index of a bank (exemplar_idx, label, text, embedding); without a number, as many cells as the root of its rows.

    Centres come from at most `sample` exemplars, those of the smallest hashes; every exemplar gets
    a cell. Vectors that are null or hold null or non-finite numbers take no part. Repeated rows
    each count; an empty bank has no cells.
    """
    bank = bank.select("exemplar_idx", "label", "text", F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    taken = bank.select("embedding").orderBy(F.xxhash64("exemplar_idx", "embedding")).limit(sample).toPandas()["embedding"]
    rows = bank.count() if cells is None else 0
    cells = max(1, min(MAX_CELLS, math.isqrt(rows) if cells is None else cells))
    centres = _fit(_matrix(taken), cells, rounds) if len(taken) else np.zeros((0, 0))
    shared = bank.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, distance double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            cell, distance = _nearest_centre(_matrix(vectors), shared.value) if len(vectors) else ((), ())
            yield pd.DataFrame({"cell": cell, "distance": distance})

    placed = checkpointed(bank.withColumn("_p", place("embedding")).select(*bank.columns, "_p.cell", "_p.distance"))
    about = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    named = bank.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    about = checkpointed(named.join(about, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    block = F.pmod(F.xxhash64("exemplar_idx", "embedding"), F.col("blocks")).cast("int")
    exemplars = placed.drop("distance").join(F.broadcast(about.select("cell", "blocks")), "cell")  # at most MAX_CELLS rows
    return Index(exemplars.select(*bank.columns, "cell", block.alias("block")), about)


def best_in_block(x: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `x`, row of `m`, inner product) of the k largest of each row of `x`, ties to the earlier row of `m`.

    A matrix product finds those that may be among them, with all that rounding may have moved;
    their inner products are summed in order. Some `TILE` products are held at once.
    """
    out = []
    step = max(1, TILE // len(m))
    longest = np.sqrt(np.square(m).sum(axis=1).max())
    for i in range(0, len(x), step):
        part = x[i : i + step]
        sims = part @ m.T
        near = np.ones(sims.shape, bool)
        if k < len(m) and np.isfinite(sims).all():
            slack = 8 * m.shape[1] * np.finfo(float).eps * np.sqrt(np.square(part).sum(axis=1)) * longest
            near = ~(sims < (-np.partition(-sims, k - 1, axis=1)[:, k - 1] - slack)[:, None])
        rows, places = np.nonzero(near)
        exact = np.zeros(len(rows))
        for d in range(m.shape[1]):
            exact = exact + part[rows, d] * m[places, d]
        order = np.lexsort((places, np.where(np.isnan(exact), -np.inf, -exact), rows))
        rows, places, exact = rows[order], places[order], exact[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        keep = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows))) < k
        out.append((rows[keep] + i, places[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best exemplars of each query; k rows of a query and partition at most are exchanged."""
    order = Window.partitionBy("_q").orderBy(F.desc("similarity"), "exemplar_idx")
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def _compared(pairs: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best of each query in the cells that it is paired with (_q, v, cell).

    Pairs meet the exemplars of a cell block by block, so a large cell spreads over tasks; the
    queries of a cell that many open are dealt over copies of its blocks.
    """
    turns = pairs.groupBy("cell").agg(F.ceil(F.count("*") / TURN).cast("int").alias("turns"))
    # at most MAX_CELLS rows; the number of blocks and turns of each cell
    grid = F.broadcast(checkpointed(turns.join(index.cells.select("cell", "blocks"), "cell")))
    asked = pairs.join(grid, "cell").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "turn": F.pmod(F.xxhash64("_q"), F.col("turns")).cast("int")})
    held = index.exemplars.join(grid, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    keys = ["cell", "block", "turn"]
    left, right = asked.select("_q", "v", *keys), held.select("exemplar_idx", "label", "text", "embedding", *keys)
    kept = StructType([StructField("_q", LongType()), *right.select("exemplar_idx", "label", "text").schema, StructField("similarity", DoubleType())])
    nothing = to_arrow_schema(kept).empty_table()

    def meet(queries: pa.Table, exemplars: pa.Table) -> pa.Table:
        if not queries.num_rows or not exemplars.num_rows:
            return nothing
        exemplars = exemplars.take(pc.sort_indices(exemplars, sort_keys=[("exemplar_idx", "ascending")], null_placement="at_start"))
        matrix = lambda column: pc.list_flatten(column).to_numpy().reshape(len(column), -1)
        rows, places, similarity = best_in_block(matrix(queries["v"]), matrix(exemplars["embedding"]), k)
        found = exemplars.select(["exemplar_idx", "label", "text"]).take(pa.array(places)).add_column(0, "_q", queries["_q"].take(pa.array(rows)))
        return found.append_column("similarity", pa.array(similarity)).combine_chunks()

    return _best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, kept), k)


def search(df: DataFrame, index: Index, vector: str = "embedding", k: int = DEFAULT.neighbours) -> DataFrame:
    """`df` with `nearest`, its k exemplars of largest inner product, ties to the smaller index, and `cells_opened`.

    Queries that are null or hold null or non-finite numbers have no neighbours and open nothing;
    repeated rows each keep their row; with fewer than k exemplars all are found; an empty index finds none.
    """
    rows = checkpointed(df.withColumn("_q", F.monotonically_increasing_id()))  # numbered once
    queries = rows.where(usable(F.col(vector))).select("_q", F.col(vector).cast("array<double>").alias("v"))
    cells = index.cells.select("cell", "centre", "radius", "n").orderBy("cell").toPandas()  # at most MAX_CELLS rows
    if len(cells) > MAX_CELLS:
        raise ValueError(f"the index has over {MAX_CELLS} cells")
    centres = _matrix(cells["centre"]) if len(cells) else np.zeros((0, 0))
    shared = df.sparkSession.sparkContext.broadcast((centres, *(cells[c].to_numpy() for c in ("radius", "n", "cell"))))

    @F.pandas_udf("array<int>")
    def opened(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Without a floor the first cells; with one the others that reach it."""
        centres, radius, n, number = shared.value
        for vectors, floors, later in batches:
            out: list = []
            for i in range(0, len(vectors), BLOCK):
                x = _matrix(vectors.iloc[i : i + BLOCK])
                if not len(n):
                    out += [[] for _ in x]
                    continue
                norm = np.sqrt(np.square(x).sum(axis=1, keepdims=True))
                # a little above the bound, for what rounding may lose
                bounds = x @ centres.T + norm * radius * (1 + 1e-9) + 1e-9 * (1 + norm * (1 + np.sqrt(np.square(centres).sum(axis=1))))
                order = np.argsort(-bounds, axis=1, kind="stable")
                for b, o, floor, second in zip(bounds, order, floors.iloc[i : i + BLOCK], later.iloc[i : i + BLOCK], strict=True):
                    first = int(np.searchsorted(np.cumsum(n[o]), k)) + 1
                    rest = o[first:]
                    out.append(number[rest[b[rest] >= floor] if second else o[:first]].tolist())
            yield pd.Series(out)

    first = checkpointed(queries.withColumn("cells", opened("v", F.lit(0.0), F.lit(False))))
    found = checkpointed(_compared(first.select("_q", "v", F.explode("cells").alias("cell")), index, k))
    floors = found.groupBy("_q").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(float("-inf")).alias("floor"))
    asked = first.join(floors, "_q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    second = checkpointed(asked.withColumn("more", opened("v", "floor", F.lit(True))).select("_q", "v", "more", F.size("cells").alias("_n")))
    more = _compared(second.select("_q", "v", F.explode("more").alias("cell")), index, k)
    best = _best(found.unionByName(more), k)
    one = F.struct((-F.col("similarity")).alias("o"), F.col("exemplar_idx").alias("i"), F.struct("label", "text", "similarity", "exemplar_idx").alias("n"))
    near = best.groupBy("_q").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["n"]).alias("nearest"))  # k of each
    counts = second.select("_q", (F.col("_n") + F.size("more")).alias("cells_opened"))
    joined = rows.join(near, "_q", "left").join(counts, "_q", "left")
    return joined.select(*df.columns, F.coalesce("nearest", F.array().cast(near.schema["nearest"].dataType)).alias("nearest"), F.coalesce("cells_opened", F.lit(0)).alias("cells_opened"))

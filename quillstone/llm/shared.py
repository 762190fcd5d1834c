"""Small helpers that the operators share: tables, staged results, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the input folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names for shared intermediate results.

    Where the setting is missing (local runs and tests) a temporary folder of this machine
    is used, which local mode can read from every task.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        root = tempfile.gettempdir()
        root = f"file://{root}"
    return f"{root.rstrip('/')}/quillstone/{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `rows` rows and about `most` bytes of `text`.

    A single longer text still comes whole, alone in its slice.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions this session deals shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows of one key that a task may always get.
FAIR = 1_000


def dealt_join(rows: DataFrame, table: DataFrame, keys: str | list[str], spread: Column, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `table` on `keys`, without one task for all rows of a frequent key.

    A key with more than a task's share of the rows is dealt over tasks by the hash of `spread`,
    and its rows of `table` (one a key, or few) are copied to each of them. There are fewer such
    keys than shuffle partitions, so their list is broadcast whatever the size of the input, and
    the copies are at most twice as many as partitions. Keys are counted in `counted`, or in
    `rows` if that is cheap to read twice.
    """
    counted = rows if counted is None else counted
    keys = [keys] if isinstance(keys, str) else keys
    width, total = shuffle_width(rows.sparkSession), counted.count()
    share = max(FAIR, -(-total // width))
    if total <= share:
        return rows.join(table, keys, how)
    often = counted.groupBy(*keys).count().where(F.col("count") > share)
    often = F.broadcast(often.select(*keys, F.ceil(F.col("count") / share).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(spread, F.lit("part")), F.col("_parts")), F.lit(0)).cast("int")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    left = rows.join(often, keys, "left").withColumn("_part", part).drop("_parts")
    right = table.join(often, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")

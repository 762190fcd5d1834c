"""The exemplar bank and vectors as tables on disk: written once, read by every session."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors

BANK = "exemplar_idx int, label string, text string, similarity_to_centroid double, original_index long, embedding array<double>"
ABOUT = "embedding_model string, embedding_dim int, num_vectors long, num_labels long, k_per_label int, diversity_threshold double"


def cached_embeddings(df: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] = vectors.embed) -> DataFrame:
    """`df` with vectors, from the table at `path` if it has as many rows; else worked out and written there.

    A table of another number of rows, or one that cannot be read, is replaced. Rows are counted,
    not compared: an input that changes without changing its size needs another path.
    """
    spark = df.sparkSession
    try:
        held = spark.read.parquet(path)
        if held.count() == df.count() and set(df.columns) <= set(held.columns):
            return held
    except Exception as e:  # no table there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    embed(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _parts(spark: SparkSession, path: str) -> list[str]:
    """The folders below `path` whose writers finished."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def embedded_once(
    df: DataFrame, path: str, model: str, embed: Callable[[DataFrame], DataFrame] = vectors.embed, text: str = "text", output: str = "embedding"
) -> DataFrame:
    """`df` with vectors, of which only those are worked out whose text this model has not embedded at `path` before.

    A vector is kept under the SHA-256 of the model's name and the text, so it follows the text
    through other ids, orders and tables; `model` must name everything that a vector depends on.
    Every call adds one part with what is new, named by no writer twice: a part without its mark of
    success is not read, and two writers that embed one text leave two equal rows, of which one is
    used. `embed` gets the column `text` and adds `embedding`. Null and empty texts are texts of
    their own; repeated rows share a vector and each keep their row; an empty table adds nothing.
    """
    spark = df.sparkSession
    name, held_text = F.lit(f"{len(model.encode())}:{model}"), F.col(text)
    key = F.sha2(F.concat(name, F.when(held_text.isNull(), "-").otherwise(F.concat(F.lit("+"), held_text))), 256)
    folder = f"{path}/{uuid.uuid5(uuid.NAMESPACE_OID, model).hex}"
    keyed = vectors.checkpointed(df.withColumn("_key", key))

    def held(parts: list[str]) -> DataFrame | None:
        return spark.read.parquet(*parts) if parts else None

    wanted, known = keyed.groupBy("_key").agg(F.any_value(text).alias("text")), held(_parts(spark, folder))
    new = vectors.checkpointed(wanted if known is None else wanted.join(known.select("_key"), "_key", "left_anti"))
    if not new.isEmpty():
        embed(new).select("_key", "embedding").write.parquet(f"{folder}/{uuid.uuid4().hex}")
    known = held(_parts(spark, folder))
    if known is None:
        return keyed.drop("_key").withColumn(output, F.lit(None).cast("array<float>"))
    found = known.groupBy("_key").agg(F.any_value("embedding").alias("_vector"))
    return keyed.join(found, "_key", "left").select(*df.columns, F.col("_vector").alias(output))


def write_bank(bank: DataFrame, path: str, embedding_model: str, per_label: int, diversity: float) -> None:
    """The bank with its vectors (the index) at `path`/exemplars, and one row about it at `path`/about."""
    bank.write.mode("overwrite").parquet(f"{path}/exemplars")
    held = bank.sparkSession.read.schema(bank.schema).parquet(f"{path}/exemplars")
    about = held.agg(
        F.lit(embedding_model).alias("embedding_model"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dim"), F.count("*").alias("num_vectors"),
        F.count_distinct("label").alias("num_labels"), F.lit(per_label).alias("k_per_label"), F.lit(diversity).alias("diversity_threshold"),
    )
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def read_bank(spark: SparkSession, path: str, embedding_model: str | None = None) -> DataFrame:
    """The bank at `path`; fails if it is missing, cut short, or made by another embedding model."""
    found = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    if found is None:
        raise ValueError(f"no bank at {path}")
    if embedding_model is not None and found.embedding_model != embedding_model:
        raise ValueError(f"the bank at {path} was made with {found.embedding_model}, not {embedding_model}")
    bank = spark.read.schema(BANK).parquet(f"{path}/exemplars")
    if bank.count() != found.num_vectors:
        raise ValueError(f"the bank at {path} should have {found.num_vectors} exemplars")
    return bank

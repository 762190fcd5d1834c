"""Extensions beyond the batch engine: documents and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import scoring, segmentation
from ..sources.documents import decoded
from ..settings import DEFAULT, Settings


def text_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """New text files below `path` as a stream of doc_id (the path) and text."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.txt").load(path)
    return found.select(F.col("path").alias("doc_id"), decoded(F.col("content")).alias("text"))


def language_risk(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Clauses of a stream (or table) of documents with their risky wording; needs no state."""
    clauses = segmentation.segment(docs.withColumn("text", clean_text(F.col("text"))), settings)
    return scoring.with_hits(clauses, settings).withColumns({"language": scoring.language_score(F.col("hits")), "tags": scoring.language_tags(F.col("hits"))}).drop("hits")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by type in event-time windows; events later than the watermark are left out in streams."""
    by = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", late).groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    counts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")



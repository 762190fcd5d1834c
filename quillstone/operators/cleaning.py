"""Cleaning of paged documents: lines that repeat between pages, and page offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..settings import DEFAULT, Settings


def repeated_lines(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, line) of `repeated_line_counts`."""
    return repeated_line_counts(pages, settings).select("doc_id", "line")


def repeated_line_counts(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, line, on) for lines that are on enough pages of a document of two pages or more.

    `pages` has doc_id, page_number, text. A line counts once a page, by its key; keys of two
    characters or less never repeat. The share asked for is `min_page_fraction`, and at least
    `min_repeat_pages` pages; `on` is how many it is on.
    """
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).where("n_pages >= 2")
    keys = pages.select("doc_id", "page_number", F.explode(F.array_distinct(F.transform(T.lines(F.col("text")), T.line_key))).alias("line"))
    per_line = keys.where(F.length("line") > 2).groupBy("doc_id", "line").agg(F.count_distinct("page_number").alias("on"))
    enough = (F.col("on") >= F.col("n_pages") * settings.min_page_fraction) & (F.col("on") >= settings.min_repeat_pages)
    return per_line.join(counts, "doc_id").where(enough).select("doc_id", "line", "on")


def clean_documents(docs: DataFrame, pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """`docs` (doc_id, text, ...) with text cleaned as a whole, repeated lines of `pages` removed."""
    found = repeated_lines(pages, settings).groupBy("doc_id").agg(F.collect_set("line").alias("_repeated"))
    joined = docs.join(found, "doc_id", "left")
    return joined.withColumn("text", T.clean_text(F.col("text"), F.col("_repeated"))).drop("_repeated")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages cleaned one by one, empty ones dropped, with offsets that run on within a document.

    The offsets index the joined cleaned pages, not the document cleaned as a whole.
    """
    # a generator of one row: the filter stays above the cleaning, which would be written out for each of them
    others = [c for c in pages.columns if c != "text"]
    cleaned = pages.select(*others, F.explode(F.array(T.clean_text(F.col("text")))).alias("text")).select(*pages.columns).where(F.length("text") > 0)
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    return cleaned.withColumn("char_start", start.cast("int")).withColumn("char_end", (start + F.length("text")).cast("int"))


def accepted(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """`docs` with a column `error` for texts that are blank or shorter than the least length."""
    n = F.length(F.coalesce("text", F.lit("")))
    error = F.when(n < settings.min_text_length, F.concat(F.lit("text too short after cleaning: "), n.cast("string"), F.lit(" characters")))
    return docs.withColumn("error", F.coalesce(F.col("error"), error) if "error" in docs.columns else error)

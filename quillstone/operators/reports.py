"""Reports over analysed clauses: summaries, rankings, breakdowns and statistics.

Clauses have doc_id, clause_id, structural_role, text, label, confidence, deviation, agrees,
skipped, used_context and risk (score, level, categories, hint). Reports are per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import CATEGORIES, STRUCTURAL_ROLES
from .vectors import checkpointed

LEVEL_PLACE = {"high": 0, "medium": 1, "low": 2}


def level_place(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LEVEL_PLACE.items() for x in kv])[level]


def top(df: DataFrame, n: int, *order: Column | str, by: str | None = "doc_id") -> DataFrame:
    """The first n rows of each `by` (or of all), in the given order. One pass of row_number, or a bounded top-n."""
    if by is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def upper_medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """(`by`, median): the element in the middle of each group's sorted values, the upper one of two; nulls do not count.

    Equal values are counted before they are exchanged, then dealt by ranges of (group, value); the
    range that holds the middle follows from the counts of ranges, and only that range is walked.
    No task holds a group, and nothing but its counts is gathered. Groups without a value have no row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    # written once, as a range's number must not change between the two uses
    dealt = checkpointed(counted.repartitionByRange("_g", "_v").withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_g", "_range").agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy("_g")  # a row for each range
    upto = F.sum("_rows").over(group.orderBy("_range"))
    ranges = ranges.withColumns({"_before": upto - F.col("_rows"), "_half": F.floor(F.sum("_rows").over(group) / 2)})
    middle = ranges.where("_before <= _half AND _half < _before + _rows").select(F.col("_g").alias("_h"), F.col("_range").alias("_r"), "_before", "_half")
    near = dealt.join(middle, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_range") == F.col("_r")))
    running = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g").orderBy("_v"))
    return near.withColumn("_upto", running).where("_upto > _half AND _upto - _n <= _half").select(F.col("_g").alias(by), F.col("_v").alias("median"))


def median_to_come() -> Column:
    """Holds the place of the median among aggregates until `with_medians` puts it in."""
    return F.lit(None).cast("double").alias("median")


def with_medians(stats: DataFrame, medians: DataFrame, by: str) -> DataFrame:
    """`stats`, one row for each group, with the median in place of its column of that name."""
    found = medians.select(F.col(by).alias("_g"), F.col("median").alias("_m"))
    columns = [F.col("_m").alias("median") if c == "median" else F.col(c) for c in stats.columns]
    return stats.join(found, F.col(by).eqNullSafe(F.col("_g")), "left").select(*columns)


def summary_columns() -> list[Column]:
    """Aggregates: clauses, and how many substantive ones are high, medium, low, and structural ones."""
    plain = ~F.col("structural_role").isin(*STRUCTURAL_ROLES)
    count = lambda level: F.count_if(plain & (F.col("risk.level") == level))
    return [F.count("*").alias("total_clauses"), count("high").alias("high"), count("medium").alias("medium"), count("low").alias("low"), F.count_if(~plain).alias("skipped_structural")]


def summary(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("doc_id").agg(*summary_columns())


def overall(high: Column, medium: Column) -> Column:
    return F.when(high > 0, "high").when(medium > 0, "medium").otherwise("low")


def shares(summaries: DataFrame) -> DataFrame:
    """Shares of the three levels; null where a document has no scored clause."""
    total = F.nullif(F.col("high") + F.col("medium") + F.col("low"), F.lit(0))
    return summaries.withColumns({f"{x}_share": F.col(x) / total for x in ("high", "medium", "low")})


def key_findings(clauses: DataFrame, n: int = 5) -> DataFrame:
    return top(clauses.where((F.col("risk.level") != "low") & (F.col("structural_role") != "SIGNATURE")), n, F.desc("risk.score"), "clause_id")


def browse(clauses: DataFrame, level: str = "all", search: str = "") -> DataFrame:
    """Clauses but signatures, of one level or all, with the words in text or label; riskiest first."""
    found = clauses.where(F.col("structural_role") != "SIGNATURE")
    if level != "all":
        found = found.where(F.col("risk.level") == level)
    if search:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search.lower()))
        found = found.where(has(F.col("text")) | has(F.col("label")))
    return found.orderBy("doc_id", level_place(F.col("risk.level")), F.desc("risk.score"), "clause_id")


def category_breakdown(clauses: DataFrame) -> DataFrame:
    """Per document one row for each of the four categories: n, and per cent of the largest."""
    named = lambda c: F.size("risk.categories") - F.size(F.array_remove("risk.categories", c))
    counts = clauses.groupBy("doc_id").agg(*[F.sum(named(c)).alias(c) for c in CATEGORIES])
    largest = F.greatest(F.lit(1), *[F.col(c) for c in CATEGORIES])
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), (F.col(c) * 100.0 / largest).alias("percent")) for c in CATEGORIES])
    return counts.select("doc_id", F.inline(pairs))


def clause_types(clauses: DataFrame, n: int = 10) -> DataFrame:
    counts = clauses.groupBy("doc_id", F.coalesce(F.nullif("label", F.lit("")), F.lit("Unclassified")).alias("label")).agg(F.count("*").alias("n"))
    return top(counts, n, F.desc("n"), "label")


def top_risks(clauses: DataFrame, n: int = 5) -> DataFrame:
    """The riskiest clauses with 300 characters of explanation, or of the hint without one."""
    said = F.coalesce(F.nullif("explanation.text", F.lit("")), F.col("risk.hint")) if "explanation" in clauses.columns else F.col("risk.hint")
    found = clauses.where(F.col("risk.level").isin("high", "medium")).withColumn("why", F.substring(said, 1, 300))
    return top(found, n, F.desc("risk.score"), "clause_id")


def portfolio(documents: DataFrame, by: str | None = None) -> DataFrame:
    """Documents, and sums of their high, medium and all clauses."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    grouped = documents.groupBy(by) if by else documents.groupBy()
    return grouped.agg(F.count("*").alias("n_documents"), total("high_count").alias("high"), total("medium_count").alias("medium"), total("total_clauses").alias("clauses"))


def newest(documents: DataFrame, n: int = 10, by: str | None = None) -> DataFrame:
    return top(documents, n, F.desc("created_at"), "id", by=by)


def deviation_stats(clauses: DataFrame, by: str = "doc_id") -> DataFrame:
    """Of substantive clauses: least, upper median, mean and largest deviation, and five bins of a fifth."""
    d = F.col("deviation")
    bins = {f"bin_{i}": F.count_if((d >= 0.2 * i if i else F.lit(True)) & (d < 0.2 * (i + 1) if i < 4 else F.lit(True))) for i in range(5)}
    stats = [F.count("*").alias("n"), F.min(d).alias("low"), median_to_come(), F.avg(d).alias("mean"), F.max(d).alias("high")]
    mismatches = F.count_if(F.col("agrees").eqNullSafe(False)).alias("mismatches")
    rows = checkpointed(clauses.where(~F.col("skipped")).select(by, "deviation", "agrees"))  # read twice
    return with_medians(rows.groupBy(by).agg(*stats, *[c.alias(n) for n, c in bins.items()], mismatches), upper_medians(rows, by, "deviation"), by)


def mismatches(clauses: DataFrame, n: int = 5) -> DataFrame:
    return top(clauses.where(~F.col("skipped") & ~F.col("agrees")), n, F.desc("deviation"), "clause_id")


def by_deviation(clauses: DataFrame) -> DataFrame:
    return clauses.orderBy("doc_id", "skipped", F.desc("deviation"), "clause_id")


def risk_stats(clauses: DataFrame) -> DataFrame:
    """Of substantive clauses: counts by level, and least, upper median, mean and largest score."""
    s = F.col("score")
    levels = [F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")]
    rows = checkpointed(clauses.where(~F.col("skipped")).select("doc_id", "risk.score", "risk.level"))  # read twice
    stats = rows.groupBy("doc_id").agg(F.count("*").alias("n"), *levels, F.min(s).alias("least"), median_to_come(), F.avg(s).alias("mean"), F.max(s).alias("most"))
    return with_medians(stats, upper_medians(rows, "doc_id", "score"), "doc_id")


def category_counts(clauses: DataFrame) -> DataFrame:
    found = clauses.where(~F.col("skipped")).select("doc_id", F.explode("risk.categories").alias("category"))
    return found.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def risk_ranking(clauses: DataFrame, n: int = 5) -> DataFrame:
    return top(clauses.where(~F.col("skipped")), n, F.desc("risk.score"), "clause_id")


def classification_stats(clauses: DataFrame) -> DataFrame:
    """Skipped, with context and alone; least, upper median, mean and largest confidence of labelled clauses."""
    c = F.col("sure_of")
    rows = checkpointed(clauses.select("doc_id", "label", "skipped", "used_context", F.when(F.col("label").isNotNull(), F.col("confidence")).alias("sure_of")))  # read twice
    # a set of labels, of which there are few: a distinct count would keep two tables of all (document, label) in a task
    stats = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.size(F.collect_set("label")).cast("long").alias("n_labels"), F.count_if("skipped").alias("skipped"), F.count_if("used_context").alias("with_context"),
        F.count_if(~F.col("skipped") & ~F.col("used_context")).alias("standalone"),
        F.min(c).alias("low"), median_to_come(), F.max(c).alias("high"), F.avg(c).alias("mean"),
        F.count_if(c >= 0.7).alias("sure"), F.count_if(c < 0.5).alias("unsure"),
    )
    return with_medians(stats, upper_medians(rows, "doc_id", "sure_of"), "doc_id")


def frequent_labels(clauses: DataFrame, n: int = 10) -> DataFrame:
    """The labels of most clauses: label, n."""
    counts = clauses.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))
    return top(counts, n, F.desc("n"), "label", by=None)


def evaluation(answered: DataFrame, expected: str = "expected_label") -> DataFrame:
    """Share of rows whose expected label comes first, and among the first three."""
    labels = F.transform(F.slice("top_k", 1, 3), lambda x: x["label"])
    first, three = F.get(labels, F.lit(0)).eqNullSafe(F.col(expected)), F.coalesce(F.array_contains(labels, F.col(expected)), F.lit(False))
    return answered.agg(F.count("*").alias("n"), F.count_if(first).alias("top1"), F.count_if(three).alias("top3"), F.avg(first.cast("int")).alias("accuracy"), F.avg(three.cast("int")).alias("accuracy_top3"))

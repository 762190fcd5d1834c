"""Places within a label and medians by ranges, against one sort of each group."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import reports, vectors


def test_places_of_a_hot_label(spark):
    """A label with most of the rows, ties by id, is dealt over tasks and ranked as by one window."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 8 else f"l{i % 3}", [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(5)
    conf = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = vectors.ranked_by_centroid(df).cache()
        window = Window.partitionBy("label").orderBy(F.desc("similarity_to_centroid"), "vec_id")
        assert found.count() == 1200 and found.columns == ["vec_id", "label", "embedding", "similarity_to_centroid", "place"]
        assert found.withColumn("want", F.row_number().over(window)).where("want <> place").isEmpty()
        ranges = df.repartitionByRange(6, "label", "vec_id").withColumn("p", F.spark_partition_id()).where("label = 'hot'").select("p").distinct().count()
        assert ranges > 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_upper_medians_of_hot_groups(spark):
    """One group with most rows, one of one value, single rows, nulls in both columns; ranges cut the hot group."""
    rng = random.Random(5)
    rows = [("hot", rng.random()) for _ in range(2001)] + [("hot", 0.25)] * 701 + [("same", 0.5)] * 400 + [(None, float(i)) for i in range(6)] + [("none", None), ("hot", None), ("one", -1.0), ("two", 2.0), ("two", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = reports.upper_medians(df, "g", "v")
        got = {r.g: r.median for r in found.collect()}
        plan = found._jdf.queryExecution().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    held: dict = {}
    for g, v in rows:
        if v is not None:
            held.setdefault(g, []).append(v)
    assert got == {g: sorted(v)[len(v) // 2] for g, v in held.items()}
    assert "collect_list" not in plan
    assert reports.upper_medians(df.limit(0), "g", "v").count() == 0

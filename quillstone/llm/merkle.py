"""Merkle manifest of a data set: a radix-ranked trie of row digests, with a proof for every row.

1. Leaves. Each row becomes the digest of its fields, where it lies; texts are never shuffled.
2. Ranks. A row's place among the rows of its source comes from counts, without a global sort: rows
   are counted by (source, doc_id without its last 12 bits), these counts are summed up over 12
   more bits at a time, and on the way down each prefix gets the number of rows below its smaller
   siblings. Only rows of one last prefix, 4,096 ids at most, are put in order. Where repeated or
   null ids crowd a prefix, digits of the row's digest and its input partition go on from there.
3. Keys. The rank of the source and the rank in the source, in hexadecimal digits, are a row's key in
   a trie of fan-out 16: nodes with the longest keys are reduced to the digest of their parent,
   whose key is one digit shorter, until the empty key is left, which is the root.
4. Proofs. From the root down every node gets the siblings of all its ancestors; those of a leaf are
   made where the run of its 16 siblings lies, so they are never shuffled.

No step needs the rows of one source, or of one id, in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt_join, staged

#: The digit of an id that a level of counts adds, in bits; rows of one last prefix that are put in order in one task.
BITS, CROWDED = 12, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of values look alike; a null is a dash."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, forged): the digest of each row, and that of the row with `forged` for its text (else null)."""

    def made(text: Column) -> Column:
        return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))

    other = F.lit(None).cast("string") if forged is None else F.when(~forged.eqNullSafe(F.col("text")), made(forged))
    return docs.select("doc_id", "source", made(F.col("text")).alias("leaf"), other.alias("forged"))


def offsets(counts: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """`counts` (group, digits, count) with `before`, the rows of the group with smaller digits, and `size`, all of the group.

    Every level sums the counts over its last digit; each sum of smaller siblings reads the children
    of one prefix only.
    """
    levels = [counts]
    for i in range(len(digits) - 1, -1, -1):
        levels.append(levels[-1].groupBy(*group, *digits[:i]).agg(F.sum("count").alias("count")))
    levels.reverse()
    found = levels[0].select(*group, F.lit(0).cast("long").alias("above"), F.col("count").alias("size"))
    for i, level in enumerate(levels[1:]):
        keys = [*group, *digits[:i]]
        smaller = Window.partitionBy(*keys).orderBy(digits[i]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("own", F.coalesce(F.sum("count").over(smaller), F.lit(0)))
        found = level.join(found, keys).select(*keys, digits[i], (F.col("above") + F.col("own")).alias("above"), "size")
    return found.withColumnRenamed("above", "before")


def depth(size: Column) -> Column:
    """How many hexadecimal digits tell `size` ranks apart: none for a single one."""
    return F.when(size > 1, F.length(F.hex(size - 1))).otherwise(0)


def _digits(rank: Column, size: Column) -> Column:
    return F.lpad(F.lower(F.hex(rank)), depth(size).cast("int"), F.lit("0"))


def _sources(sizes: DataFrame) -> DataFrame:
    """(place, key, level): the digits of each source's rank, and how many these are; one row for each source is sorted."""
    at = staged(sizes.select("place").orderBy("place").withColumn("at", F.monotonically_increasing_id()))
    parts = at.groupBy(F.shiftright("at", 33).alias("part")).count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy()).alias("sources"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    joined = at.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part")
    return joined.select("place", _digits(rank, F.col("sources")).alias("source_key"), depth(F.col("sources")).alias("level"))


def keyed(rows: DataFrame) -> DataFrame:
    """The `leaves` with their `key` in the trie, and `level`, the number of its digits that tell the source."""
    place = F.coalesce(F.concat(F.lit("+"), "source"), F.lit(""))  # null first, then by bytes
    lowest = -(1 << 63 - BITS) - 1
    prefix = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BITS), F.lit(lowest))
    base = staged(rows.select("doc_id", "leaf", "forged", place.alias("place"), prefix.alias("b"), F.monotonically_increasing_id().alias("uid")))
    shifts = range(60 - BITS, -1, -BITS)  # digits are prefixes of b; each tells the ones before it too
    names = [f"b{s}" if s else "b" for s in shifts]
    counts = base.groupBy("place", "b").count().select("*", *(F.shiftright("b", s).alias(n) for s, n in zip(shifts, names, strict=True) if s))
    counts = staged(counts)
    crowded = staged(counts.where(F.col("count") > CROWDED).select("place", "b"))
    sizes = counts.groupBy("place").agg(F.sum("count").alias("count"))
    # what is known of a source goes down with the counts, so rows are never joined by their source
    found = offsets(counts, ["place"], names).select("place", "b", "before", "size")
    found = staged(dealt_join(found, _sources(sizes), "place", F.col("b")))

    def placed(df: DataFrame, within: Column) -> DataFrame:
        key = F.concat("source_key", _digits(F.col("before") + within, F.col("size")))
        return df.select("doc_id", "leaf", "forged", key.alias("key"), F.length(key).alias("len"), "level")

    order = [F.col("doc_id").asc_nulls_first(), "leaf", "uid"]
    in_order = F.row_number().over(Window.partitionBy("place", "b").orderBy(*order)) - 1
    if crowded.isEmpty():
        return placed(base.join(found, ["place", "b"]), in_order)
    plain = base.join(F.broadcast(crowded) if crowded.count() < CROWDED else crowded, ["place", "b"], "left_anti")
    more = ["e0", "e1", "e2", "e3", "e4"]
    tied = dealt_join(base, crowded, ["place", "b"], F.col("uid")).select(
        "*", F.coalesce("doc_id", F.lit(0)).alias("e0"), F.substring("leaf", 1, 3).alias("e1"), F.substring("leaf", 4, 3).alias("e2"),
        F.col("leaf").alias("e3"), F.shiftright("uid", 33).alias("e4"),
    )
    tied = staged(tied)
    deep = offsets(staged(tied.groupBy("place", "b", *more).count()), ["place", "b"], more).select("place", "b", *more, F.col("before").alias("inner"))
    deep = dealt_join(deep, found.join(crowded, ["place", "b"], "left_semi"), ["place", "b"], F.col("e3"))
    same = F.row_number().over(Window.partitionBy("place", "b", *more).orderBy("uid")) - 1
    return placed(plain.join(found, ["place", "b"]), in_order).unionByName(placed(tied.join(deep, ["place", "b", *more]), F.col("inner") + same))


def proofs(rows: DataFrame) -> DataFrame:
    """The `leaves` with subroot (their source's digest), root, and path: the siblings left and right of each ancestor, from the leaf up.

    Rows ascend by doc_id in their source, nulls first; rows of one id by their digests. Sources
    ascend by their bytes, null first. A run of one node still becomes a digest of it; a single row
    is its own root with an empty path; an empty table gives no rows.
    """
    nodes = staged(keyed(rows), "len")
    lengths = sorted(r["len"] for r in nodes.select("len").distinct().collect())  # a few dozen at most
    if not lengths:
        return nodes.select("doc_id", "leaf", "forged", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.lit(None).cast(PATH).alias("path"))
    kept = F.struct("doc_id", "forged", F.lit(True).alias("row"))
    whole = nodes.select("key", "level", F.col("leaf").alias("hash"), kept.alias("own"), "len")
    runs: dict[int, DataFrame] = {}
    above = None
    for n in range(lengths[-1], 0, -1):
        level = [whole.where(F.col("len") == n).drop("len")] * (n in lengths) + ([above] if above is not None else [])
        level = reduce(DataFrame.unionByName, level).select(F.substring("key", 1, n - 1).alias("parent"), "level", F.struct("key", "hash", "own").alias("node"))
        runs[n] = staged(level.groupBy("parent").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.min("level").alias("level")))
        joined = F.sha2(F.array_join(F.transform("nodes", lambda x: x["hash"]), ""), 256)
        none = F.lit(None).cast(whole.schema["own"].dataType)
        above = runs[n].select(F.col("parent").alias("key"), "level", joined.alias("hash"), none.alias("own"))
    top = above if above is not None else whole.drop("len")
    top = top.select("key", "hash", "own", F.array().cast(PATH).alias("path"), F.when(F.col("level") == 0, F.col("hash")).alias("subroot"), F.col("hash").alias("root"))
    out = [top.where("own is not null")] if lengths == [0] else []
    for n in range(1, lengths[-1] + 1):
        inner = top.where("own is null").select(F.col("key").alias("parent"), F.col("path").alias("upper"), F.col("subroot").alias("sub"), "root")
        met = runs[n].join(inner, "parent").select("*", F.posexplode("nodes").alias("at", "node"))
        beside = lambda part: F.array_join(F.transform(part, lambda x: x["hash"]), "")
        left, right = beside(F.slice("nodes", 1, F.col("at"))), beside(F.slice("nodes", F.col("at") + 2, F.lit(16)))
        cells = met.select(
            "node.*", "root", F.when(F.col("level") == n, F.col("node.hash")).otherwise(F.col("sub")).alias("subroot"),
            F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "upper").cast(PATH).alias("path"),
        )
        if n in lengths:
            out.append(cells.where("own is not null"))
        if n < lengths[-1]:
            top = staged(cells.where("own is null"))
    return reduce(DataFrame.unionByName, [df.select("own.doc_id", F.col("hash").alias("leaf"), "own.forged", "subroot", "root", "path") for df in out])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda got, x: F.sha2(F.concat(x["left"], got, x["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def audited(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest of documents, checked against texts that lost their capitals where `every` divides crc32(doc_id).

    Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the text as it is now and
    the siblings as they were) and verified. Any column may be null; a null text or id is not
    tampered with; repeated rows are leaves of their own; other columns are not read; an empty
    table gives no rows.
    """
    chosen = F.crc32(F.col("doc_id").cast("string")) % every == 0
    forged = F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    proven = proofs(leaves(docs, forged)).withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

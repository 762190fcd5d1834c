"""Synthetic contracts made from order lines, by SQL that Spark and DuckDB both run.

An order is a contract, its lines are clauses: numbered, lettered, or structural. The wording of
a line follows from its part, so that most scoring rules are met; signals stand in for a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = (
    "The Supplier may change the fees at any time in its sole discretion.",
    "Payment is due within thirty days of the invoice date.",
    "The Buyer shall indemnify and hold harmless the Supplier from any and all claims whatsoever.",
    "This agreement shall automatically renew unless ended in writing by either side.",
    "The license is granted in perpetuity and throughout the world.",
    "Fill in ________ and [INSERT NAME] before signing this page.",
    "Either party may end this agreement with or without cause and without prior notice.",
    "Deliveries are made to the address that the order names.",
    "The Employee shall not for any reason compete with the Company anywhere in the state.",
    "The Tenant waives all rights to a hearing and irrevocably assigns the claim.",
    "Notice is given ninety days ahead, that is 90 (ninety) days before the end.",
    "Records are kept for five (5) years and for a period of ten years if audited.",
)
STRUCTURE = ("WHEREAS the parties wish to trade on the terms below;", "IN WITNESS WHEREOF the parties have signed this agreement.")
LABELS = ("Terminations", "Payments", "Indemnifications", "Notices", "Governing Laws", "Confidentiality", "Counterparts")

_PHRASE = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
_LABEL = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(LABELS)) + " END"

#: One row for each line: doc_id, rn, kind, number, line, and signals.
LINES = f"""
  SELECT doc_id, rn, kind, number, l_partkey,
         CASE kind WHEN 'open' THEN '{STRUCTURE[0]}' WHEN 'close' THEN '{STRUCTURE[1]}'
              WHEN 'letter' THEN '(a) ' || phrase ELSE number || '. ' || phrase END AS line,
         label, confidence, deviation, agrees
  FROM (
    SELECT l_orderkey AS doc_id, rn, l_partkey,
           CASE WHEN rn = 1 AND l_orderkey % 3 = 0 THEN 'open' WHEN rn = 7 THEN 'close' WHEN rn > 1 AND rn % 3 = 0 THEN 'letter' ELSE 'number' END AS kind,
           CASE WHEN (rn = 1 AND l_orderkey % 3 = 0) OR rn = 7 THEN CAST(NULL AS VARCHAR(9)) WHEN rn > 1 AND rn % 3 = 0 THEN '(a)' ELSE CAST(rn AS VARCHAR(9)) END AS number,
           {_PHRASE} AS phrase, {_LABEL} AS label,
           CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence, CAST(l_suppkey % 13 AS DOUBLE) / 13 AS deviation,
           CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS agrees
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem) numbered
  ) described
"""

#: One row for each clause as segmentation gives it: offsets, level, parent and role follow from the lines.
CLAUSES = f"""
  SELECT *, CASE kind WHEN 'letter' THEN 2 ELSE 1 END AS level,
         CASE kind WHEN 'letter' THEN 'SUBCLAUSE' WHEN 'open' THEN 'RECITAL' WHEN 'close' THEN 'SIGNATURE' ELSE 'CLAUSE' END AS structural_role,
         CAST(rn - 1 AS INTEGER) AS clause_id,
         CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start
  FROM ({LINES}) l
"""


#: Contracts that meet every marker pattern, an overlap, a fragment and three levels. A line holds the
#: order's key ({k}) or customer ({c}).
MARKED = (
    "BY AND BETWEEN the buyer {c} and the seller that is named below.",
    "RECITALS of the parties to this agreement follow here.",
    "WHEREAS the buyer wishes to buy goods under order {k}",
    "WITNESSETH that the parties have agreed to all of this",
    "NOW, THEREFORE the parties agree on the terms that follow",
    "ARTICLE IV General terms that govern all of the deliveries",
    "Section 2.1 Deliveries are made to the address of buyer {c}",
    "Clause 3 Risk passes to the buyer when goods are delivered",
    "1. The price of order {k} is due when goods are delivered",
    "1.1 Payment is made within thirty days of the invoice date",
    "1.1.1 Late payment bears interest for every day of delay",
    "(iv) interest is charged on the whole amount that is open",
    "(b) the seller may stop deliveries until payment is made",
    "(c) goods stay property of the seller until they are paid",
    "IX. The seller answers for defects for one year only",
    "d. Defects are notified in writing within eight days",
    "(e) and so on;",
    "3. Notices are sent to the addresses given at the beginning",
    "4. (ii) the parties keep each other informed about order {k}",
    "4.1 (a) both parties may end the agreement within a month",
    "5. What remains open … is settled by the parties in good faith",
    "IN WITNESS WHEREOF the parties have signed order {k}",
)
#: What segmentation makes of them: text (or a line's number), level, parent, children, number, role.
#: A fragment joins the clause before it; of markers close to each other the more specific one
#: stays; after the ellipsis positions are two further on.
MARKED_CLAUSES = (
    (0, 1, None, "", None, "PARTIES"),
    (1, 1, None, "", None, "RECITAL"),
    (2, 1, None, "", None, "RECITAL"),
    (3, 1, None, "", None, "RECITAL"),
    (4, 1, None, "", None, "RECITAL"),
    (5, 1, None, "", "ARTICLE IV", "CLAUSE"),
    (6, 1, None, "", "Section 2.1", "CLAUSE"),
    (7, 1, None, "", "Clause 3", "CLAUSE"),
    (8, 1, None, "9,12,13,14,15", "1", "CLAUSE"),
    (9, 2, 8, "10,11", "1.1", "SUBCLAUSE"),
    (10, 3, 9, "", "1.1.1", "SUBCLAUSE"),
    (11, 3, 9, "", "(iv)", "SUBCLAUSE"),
    (12, 2, 8, "", "(b)", "SUBCLAUSE"),
    (13, 2, 8, "", "(c)", "SUBCLAUSE"),
    (14, 2, 8, "", "IX", "SUBCLAUSE"),
    (MARKED[15] + "\n" + MARKED[16], 2, 8, "", "d.", "SUBCLAUSE"),
    (MARKED[17] + "\n4.", 1, None, "17,18", "3", "CLAUSE"),
    (MARKED[18].removeprefix("4. "), 3, 16, "", "(ii)", "SUBCLAUSE"),
    (19, 2, 16, "", "4.1", "SUBCLAUSE"),
    (MARKED[20] + "\nIN", 1, None, "", "5", "CLAUSE"),
    (MARKED[21].removeprefix("IN "), 1, None, "", None, "SIGNATURE"),
)


def filled(text: str) -> str:
    """SQL for a text of MARKED with its values put in."""
    sql = "'" + text.replace("{k}", "' || CAST(o_orderkey AS VARCHAR(20)) || '").replace("{c}", "' || CAST(o_custkey AS VARCHAR(20)) || '") + "'"
    return sql.replace("\n", "' || chr(10) || '")


MARKED_SQL = f"SELECT o_orderkey AS doc_id, {filled(chr(10).join(MARKED))} AS text FROM orders"
_ROW = lambda i, text, level, parent, children, number, role: (
    f"SELECT o_orderkey AS doc_id, {i} AS clause_id, {filled(MARKED[text] if isinstance(text, int) else text)} AS text, {level} AS level, "
    f"CAST({'NULL' if parent is None else parent} AS INTEGER) AS parent_id, '{children}' AS child_ids, {'NULL' if number is None else repr(number)} AS number, "
    f"'{role}' AS structural_role, '{'number' if number else 'structural'}' AS boundary_kind FROM orders"
)
#: One row for each clause that is expected; offsets are where its text stands.
MARKED_CLAUSES_SQL = f"""
  SELECT c.*, CAST(strpos(d.text, c.text) - 1 AS INTEGER) AS char_start, CAST(strpos(d.text, c.text) - 1 + length(c.text) AS INTEGER) AS char_end
  FROM ({" UNION ALL ".join(_ROW(i, *c) for i, c in enumerate(MARKED_CLAUSES))}) c JOIN ({MARKED_SQL}) d USING (doc_id)
"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a contract of MARKED for each order; short rows are dealt before they grow."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return spark.sql(f"WITH orders AS (SELECT * FROM {{orders}}) {MARKED_SQL}", orders=orders)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(f"WITH lineitem AS (SELECT * FROM {{items}}) {LINES}", items=lineitem)


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with their signals, as the scorer takes them."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = spark.sql(f"WITH lineitem AS (SELECT * FROM {{items}}) {CLAUSES}", items=lineitem)
    return found.selectExpr(
        "doc_id", "clause_id", "line AS text", "char_start", "char_start + length(line) AS char_end", "level", "number", "structural_role",
        "CASE WHEN structural_role IN ('RECITAL', 'SIGNATURE') THEN structural_role ELSE label END AS label",
        "CASE WHEN structural_role IN ('RECITAL', 'SIGNATURE') THEN 1.0D ELSE confidence END AS confidence",
        "deviation", "agrees", "structural_role IN ('RECITAL', 'SIGNATURE') AS skipped", "clause_id % 2 = 1 AND level = 2 AS used_context",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the lines of each contract."""
    held = F.sort_array(F.collect_list(F.struct("rn", "line")))
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("text"))

"""The registered queries of the engine and their SQL for DuckDB.

Every query runs over its whole tables. Model and provider stages have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cells, classification, cleaning, explanation, reports, scoring, segmentation, vectors
from ..settings import DEFAULT, HINTS, LABEL_CATEGORY, LABEL_MULTIPLIER, LEXICON, TAG_CATEGORY
from ..sources import store
from ..streaming import ingest
from . import analysis, contracts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- the scorer in SQL ----

_HIT = ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN {{'w': CAST({w} AS DOUBLE), 't': '{t}'}} END" for p, w, t in LEXICON)
_WHEN = lambda table, column: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {f'CAST({v} AS DOUBLE)' if isinstance(v, float) else repr(v)}" for k, v in table.items()) + " END"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"

CLAUSES_SQL = f"""
  SELECT doc_id, clause_id, line AS text, char_start, char_start + length(line) AS char_end, level, number, structural_role,
         structural_role IN ('RECITAL', 'SIGNATURE') AS skipped,
         CASE WHEN structural_role IN ('RECITAL', 'SIGNATURE') THEN structural_role ELSE label END AS label,
         CASE WHEN structural_role IN ('RECITAL', 'SIGNATURE') THEN 1.0 ELSE confidence END AS confidence,
         deviation, agrees, clause_id % 2 = 1 AND level = 2 AS used_context
  FROM ({contracts.CLAUSES}) c
"""

SCORED_SQL = f"""
  WITH given AS ({CLAUSES_SQL}),
  hits AS (
    SELECT *, list_filter([{_HIT}], lambda h: h IS NOT NULL) AS hits,
           list_concat(list_concat(regexp_extract_all(text, '<<[^>]+>>'), regexp_extract_all(text, '_{{4,}}')), regexp_extract_all(text, '\\[INSERT[^\\]]*\\]')) AS holes
    FROM given
  ), worded AS (
    SELECT *, list_reverse_sort(list_transform(hits, lambda h: h.w)) AS ws, list_transform(hits, lambda h: h.t) AS ts,
           len(holes) >= 2 OR CAST(coalesce(list_sum(list_transform(holes, lambda x: length(x))), 0) AS DOUBLE) / greatest(length(text), 1) > 0.15 AS form,
           char_end - char_start AS n
    FROM hits
  ), signals AS (
    SELECT *, CASE WHEN len(ws) = 0 THEN 0.0 ELSE least(1.0, ws[1] + 0.4 * coalesce(list_sum(ws[2:]), 0.0)) END AS wording,
           list_filter(ts, lambda t, i: list_position(ts, t) = i) AS tags,
           CASE WHEN n < 50 THEN 0.5 WHEN n < 100 THEN 0.5 * (1 - (n - 50) / 50.0) ELSE 0.0 END AS short,
           CASE WHEN agrees = false THEN 1.0 ELSE 0.0 END AS mismatch,
           coalesce({_WHEN(LABEL_MULTIPLIER, "label")}, 1.0) AS factor
    FROM worded
  ), weighed AS (
    SELECT *, (0.4 * deviation + 0.4 * (1 - confidence) + 0.2 * mismatch + 0.4 * wording) / 1.4 * (1 - short) * CASE WHEN form THEN 0.5 ELSE 1.0 END AS raw FROM signals
  ), scaled AS (
    SELECT *, (CASE WHEN confidence < 0.25 AND wording < 0.5 THEN least(raw, 0.29) ELSE raw END) * factor AS x FROM weighed
  ), raised AS (
    SELECT *, CASE WHEN wording >= 0.85 AND x < 0.7 THEN 0.7 WHEN wording >= 0.65 AND wording < 0.85 AND x < 0.5 THEN 0.5 ELSE greatest(0.0, least(1.0, x)) END AS y,
           CASE WHEN wording >= 0.85 AND x < 0.7 THEN 'high' WHEN wording >= 0.65 AND wording < 0.85 AND x < 0.5 THEN 'medium' ELSE '' END AS override
    FROM scaled
  ), levelled AS (
    SELECT *, CASE WHEN skipped THEN 'low' WHEN y >= 0.7 THEN 'high' WHEN y >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level,
           CASE WHEN skipped THEN 0.0 ELSE round(y, 4) END AS risk_score FROM raised
  ), named AS (
    SELECT *, CASE WHEN skipped OR label IS NULL THEN [] ELSE
             list_concat(list_concat(
               CASE WHEN risk_level = 'low' THEN [] WHEN label IN {_IN(LABEL_CATEGORY["Legal"])} THEN ['Legal'] WHEN label IN {_IN(LABEL_CATEGORY["Financial"])} THEN ['Financial']
                    WHEN label IN {_IN(LABEL_CATEGORY["Operational"])} THEN ['Operational'] ELSE [] END,
               list_filter(list_transform(tags, lambda t: {_WHEN(TAG_CATEGORY, "t")}), lambda c: c IS NOT NULL)),
               CASE WHEN mismatch > 0 AND (confidence < 0.35 OR deviation > 0.55) AND NOT form THEN ['Ambiguity'] ELSE [] END) END AS cs
    FROM levelled
  )
  SELECT *, list_filter(cs, lambda c, i: list_position(cs, c) = i) AS categories FROM named
"""

_SCORED = f"WITH scored AS ({SCORED_SQL})"


def _said(name: str, value: str | None = None) -> str:
    before, _, after = HINTS[name].replace("'", "''").partition("{}")
    return f"'{before}'" if value is None else f"'{before}' || {value} || '{after}'"


_PER_CENT = lambda x: f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_PARTS = (
    f"CASE WHEN coalesce(label, '') <> '' THEN {_said('label', 'label')} ELSE {_said('unlabelled')} END",
    f"CASE risk_level WHEN 'high' THEN {_said('high')} WHEN 'medium' THEN {_said('medium')} END",
    f"CASE WHEN len(tags) > 0 THEN {_said('tags', 'array_to_string(tags, CHR(44) || CHR(32))')} END",
    f"CASE WHEN override <> '' THEN {_said('override', 'override')} END",
    f"CASE WHEN form THEN {_said('form')} END",
    f"CASE WHEN NOT form AND override = '' AND confidence < 0.25 AND len(tags) = 0 THEN {_said('floor', _PER_CENT('confidence'))} END",
    f"CASE WHEN NOT form AND NOT (override = '' AND confidence < 0.25 AND len(tags) = 0) AND confidence < 0.5 THEN {_said('unsure', _PER_CENT('confidence'))} END",
    f"CASE WHEN plain AND deviation > 0.55 THEN {_said('far', _PER_CENT('deviation'))} WHEN plain AND deviation > 0.35 THEN {_said('off', _PER_CENT('deviation'))} END",
    f"CASE WHEN plain AND mismatch > 0 THEN {_said('mismatch')} END",
    f"CASE WHEN plain AND short > 0 THEN {_said('short')} END",
)
#: `scored` with the sentence of reasons.
HINTED_SQL = f"""
  SELECT *, CASE WHEN skipped THEN {_said("structural", "structural_role")}
                 ELSE array_to_string(list_filter([{", ".join(_PARTS)}], lambda x: x IS NOT NULL), '{HINTS["between"]}') END AS hint
  FROM (SELECT *, NOT form AND override = '' AND NOT (confidence < 0.25 AND len(tags) = 0) AS plain FROM scored) s
"""


def _scored(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    return scoring.score(contracts.clauses(spark, sf_dir), wanted=wanted or scoring.RISK)


def _flat(scored: DataFrame, *columns: str) -> DataFrame:
    return scored.select("doc_id", "clause_id", *columns, F.col("risk.level").alias("risk_level"), F.col("risk.score").alias("risk_score"))


# ---- the flagship: text to risk summary ----


@query(f"""{_SCORED}
  SELECT doc_id, count(*) AS total_clauses, count(*) FILTER (WHERE wording >= 0.85) AS high,
         count(*) FILTER (WHERE wording >= 0.65 AND wording < 0.85) AS medium, count(*) FILTER (WHERE structural_role IN ('RECITAL', 'SIGNATURE')) AS structural,
         round(max(wording), 6) AS worst
  FROM scored GROUP BY doc_id""")
def flagship_contract_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as text, segmented, their risky wording scored, counted per contract."""
    clauses = segmentation.segment(contracts.documents(spark, sf_dir))
    worded = scoring.with_hits(clauses).withColumn("w", scoring.language_score(F.col("hits")))
    return worded.groupBy("doc_id").agg(
        F.count("*").alias("total_clauses"),
        F.count_if(F.col("w") >= 0.85).alias("high"),
        F.count_if((F.col("w") >= 0.65) & (F.col("w") < 0.85)).alias("medium"),
        F.count_if(scoring.is_structural(F.col("structural_role"))).alias("structural"),
        F.round(F.max("w"), 6).alias("worst"),
    )


@query(f"""
  SELECT doc_id, clause_id, char_start, char_start + length(line) AS char_end, level, number, structural_role, line AS text,
         CASE WHEN level = 2 THEN max(CASE WHEN level = 1 THEN clause_id END) OVER (PARTITION BY doc_id ORDER BY rn) END AS parent_id
  FROM ({contracts.CLAUSES}) c""")
def segment_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with offsets, levels, parents and roles."""
    found = segmentation.segment(contracts.documents(spark, sf_dir))
    return found.select("doc_id", "clause_id", "char_start", "char_end", "level", "number", "structural_role", "text", "parent_id")


@query(contracts.MARKED_CLAUSES_SQL)
def segment_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of contracts that meet every marker pattern, an overlap, a fragment, an ellipsis and three levels."""
    found = segmentation.segment(contracts.marked(spark, sf_dir))
    return found.withColumn("child_ids", F.array_join(F.col("child_ids").cast("array<string>"), ","))


@query("SELECT count(DISTINCT l_orderkey) AS n_documents, count(*) AS n_clauses, 0 AS n_wrong FROM lineitem")
def offset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clauses there are, and how many differ from the text at their offsets."""
    docs = contracts.documents(spark, sf_dir)
    checked = segmentation.with_offsets_checked(segmentation.segment(docs), docs)
    per_document = checked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.col("offsets_hold")).alias("wrong"))
    return per_document.agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_clauses"), F.sum("wrong").cast("int").alias("n_wrong"))


@query(f"""
  SELECT doc_id, clause_id, CASE WHEN level = 2 AND p_number IS NOT NULL THEN '[Context: parent clause ' || p_number || ']: ' || p_number || '. '
         WHEN level = 2 AND parent IS NOT NULL THEN '[Context: parent clause]: {contracts.STRUCTURE[0]}' END AS context
  FROM (
    SELECT *, max(CASE WHEN level = 1 THEN clause_id END) OVER w AS parent, arg_max(number, rn) FILTER (WHERE level = 1 AND number IS NOT NULL) OVER w AS last_number,
           CASE WHEN arg_max(kind, rn) FILTER (WHERE level = 1) OVER w = 'number' THEN arg_max(number, rn) FILTER (WHERE level = 1 AND number IS NOT NULL) OVER w END AS p_number
    FROM ({contracts.CLAUSES}) c WINDOW w AS (PARTITION BY doc_id ORDER BY rn)
  ) t""")
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that each clause gets from its parent."""
    clauses = segmentation.segment(contracts.documents(spark, sf_dir))
    return classification.with_context(clauses).select("doc_id", "clause_id", "context")


# ---- scoring ----


@query(f"""{_SCORED} SELECT doc_id, clause_id, risk_score, risk_level, array_to_string(categories, ',') AS categories,
  round(CASE WHEN skipped THEN 0.0 ELSE wording END, 6) AS wording, array_to_string(CASE WHEN skipped THEN [] ELSE tags END, ',') AS tags,
  CASE WHEN skipped THEN '' ELSE override END AS override, CASE WHEN skipped THEN false ELSE form END AS placeholder, CASE WHEN skipped THEN false ELSE confidence < 0.25 END AS floored,
  CASE WHEN skipped THEN 1.0 ELSE factor END AS multiplier FROM scored""")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, level, categories and signals of every clause."""
    s = F.col("risk.signals")
    return _flat(
        _scored(spark, sf_dir).select(
            "*",
            F.array_join("risk.categories", ",").alias("categories"),
            F.round(s["risky_language_score"], 6).alias("wording"),
            F.array_join(s["risky_language_tags"], ",").alias("tags"),
            s["override_applied"].alias("override"),
            s["placeholder_clause"].alias("placeholder"),
            s["confidence_floor_hit"].alias("floored"),
            s["label_multiplier"].alias("multiplier"),
        ),
        "categories", "wording", "tags", "override", "placeholder", "floored", "multiplier",
    )


@query(f"{_SCORED} SELECT doc_id, clause_id, risk_level, risk_score, hint FROM ({HINTED_SQL}) h")
def risk_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of reasons of every clause."""
    return _flat(_scored(spark, sf_dir, "score", "level", "hint").withColumn("hint", F.col("risk.hint")), "hint")


# ---- reports ----

_COUNTS = "count(*) FILTER (WHERE NOT skipped AND risk_level = '{x}') AS {x}"


@query(f"""{_SCORED}, s AS (SELECT doc_id, count(*) AS total_clauses, {_COUNTS.format(x="high")}, {_COUNTS.format(x="medium")}, {_COUNTS.format(x="low")},
  count(*) FILTER (WHERE skipped) AS skipped_structural FROM scored GROUP BY doc_id)
  SELECT *, CASE WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END AS overall_risk, round(CAST(high AS DOUBLE) / nullif(high + medium + low, 0), 6) AS high_share FROM s""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.shares(reports.summary(_scored(spark, sf_dir, "level")))
    return found.withColumn("overall_risk", reports.overall(F.col("high"), F.col("medium"))).withColumn("high_share", F.round("high_share", 6)).drop("medium_share", "low_share")


@query(f"""{_SCORED} SELECT doc_id, clause_id, risk_level, risk_score FROM scored WHERE risk_level <> 'low' AND structural_role <> 'SIGNATURE'
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY risk_score DESC, clause_id) <= 5""")
def key_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(reports.key_findings(_scored(spark, sf_dir, "score", "level")))


@query(f"""{_SCORED} SELECT doc_id, clause_id, risk_level, risk_score FROM scored
  WHERE structural_role <> 'SIGNATURE' AND risk_level = 'high' AND (contains(lower(text), 'notice') OR contains(lower(coalesce(label, '')), 'notice'))""")
def browse_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(reports.browse(_scored(spark, sf_dir, "score", "level"), "high", "Notice"))


@query(f"""{_SCORED}, c AS (SELECT doc_id, unnest(categories) AS category FROM scored),
  n AS (SELECT d.doc_id, k.category, count(c.category) AS n FROM (SELECT DISTINCT doc_id FROM scored) d
        CROSS JOIN (VALUES ('Financial'), ('Legal'), ('Operational'), ('Ambiguity')) k(category) LEFT JOIN c ON c.doc_id = d.doc_id AND c.category = k.category GROUP BY ALL)
  SELECT *, round(n * 100.0 / greatest(1, max(n) OVER (PARTITION BY doc_id)), 6) AS percent FROM n""")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.category_breakdown(_scored(spark, sf_dir, "categories"))
    return found.select("doc_id", "category", F.col("n").cast("long").alias("n"), F.round(F.col("percent").cast("double"), 6).alias("percent"))


@query(f"""{_SCORED} SELECT * FROM (SELECT doc_id, coalesce(label, 'Unclassified') AS label, count(*) AS n FROM scored GROUP BY 1, 2) t
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) <= 3""")
def clause_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels are there before any scoring
    return reports.clause_types(contracts.clauses(spark, sf_dir), 3)


@query(f"""{_SCORED} SELECT doc_id, clause_id, risk_level, risk_score, hint[1:300] AS why FROM ({HINTED_SQL}) h WHERE risk_level IN ('high', 'medium')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY risk_score DESC, clause_id) <= 5""")
def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(reports.top_risks(_scored(spark, sf_dir, "score", "level", "hint")), "why")


@query(f"""{_SCORED} SELECT doc_id, count(*) AS n, min(deviation) AS low, list_sort(list(deviation))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median, round(avg(deviation), 6) AS mean, max(deviation) AS high,
  {", ".join(f"count(*) FILTER (WHERE deviation >= {0.2 * i} AND (deviation < {0.2 * (i + 1)} OR {i} = 4)) AS bin_{i}" for i in range(5))},
  count(*) FILTER (WHERE agrees = false) AS mismatches FROM scored WHERE NOT skipped GROUP BY doc_id""")
def deviation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.deviation_stats(contracts.clauses(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"""{_SCORED} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE risk_level = 'high') AS high, count(*) FILTER (WHERE risk_level = 'medium') AS medium,
  count(*) FILTER (WHERE risk_level = 'low') AS low, min(risk_score) AS least, list_sort(list(risk_score))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median, round(sum(risk_score), 4) AS total, max(risk_score) AS most
  FROM scored WHERE NOT skipped GROUP BY doc_id""")
def risk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.risk_stats(_scored(spark, sf_dir, "score", "level")).withColumn("mean", F.round(F.col("mean") * F.col("n"), 4)).withColumnRenamed("mean", "total")


@query(f"""WITH c AS ({CLAUSES_SQL}) SELECT doc_id, clause_id, deviation FROM c WHERE NOT skipped AND agrees = false
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY deviation DESC, clause_id) <= 5""")
def mismatched_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mismatches(contracts.clauses(spark, sf_dir)).select("doc_id", "clause_id", "deviation")


@query(f"{_SCORED} SELECT doc_id, category, count(*) AS n FROM (SELECT doc_id, unnest(categories) AS category FROM scored WHERE NOT skipped) c GROUP BY ALL")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_counts(_scored(spark, sf_dir, "categories"))


@query(f"""{_SCORED} SELECT doc_id, clause_id, risk_level, risk_score FROM scored WHERE NOT skipped
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY risk_score DESC, clause_id) <= 5""")
def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(reports.risk_ranking(_scored(spark, sf_dir, "score", "level")))


@query(f"""WITH c AS ({CLAUSES_SQL}) SELECT label, count(*) AS n FROM c WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 10""")
def frequent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten labels that most clauses have."""
    return reports.frequent_labels(contracts.clauses(spark, sf_dir))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—' WHEN o_orderkey % 5 = 1 THEN 'order ' || o_orderkey
  ELSE strftime(o_orderdate, '%b ') || day(o_orderdate) || ', ' || year(o_orderdate) END AS shown FROM orders""")
def shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as reports show them; a dash for none, other text as it is."""
    key = F.col("o_orderkey")
    iso = F.when(key % 5 == 0, None).when(key % 5 == 1, F.concat(F.lit("order "), key.cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.shown_date(iso).alias("shown"))


@query(f"""WITH c AS ({CLAUSES_SQL}) SELECT doc_id, count(*) AS n, count(DISTINCT label) AS n_labels, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE used_context) AS with_context,
  count(*) FILTER (WHERE NOT skipped AND NOT used_context) AS standalone, min(confidence) FILTER (WHERE label IS NOT NULL) AS low,
  list_sort(list(confidence) FILTER (WHERE label IS NOT NULL))[CAST(floor(count(label) / 2) AS INTEGER) + 1] AS median, max(confidence) FILTER (WHERE label IS NOT NULL) AS high,
  round(avg(confidence) FILTER (WHERE label IS NOT NULL), 6) AS mean, count(*) FILTER (WHERE label IS NOT NULL AND confidence >= 0.7) AS sure, count(*) FILTER (WHERE label IS NOT NULL AND confidence < 0.5) AS unsure
  FROM c GROUP BY doc_id""")
def classification_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.classification_stats(contracts.clauses(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_partkey % 5 = l_suppkey % 5) AS top1, count(*) FILTER (WHERE (l_suppkey - l_partkey) % 5 IN (0, 1, 2, -3, -4)) AS top3,
  round(avg(CAST(l_partkey % 5 = l_suppkey % 5 AS INTEGER)), 9) AS accuracy, round(avg(CAST((l_suppkey - l_partkey) % 5 IN (0, 1, 2, -3, -4) AS INTEGER)), 9) AS accuracy_top3 FROM lineitem""")
def evaluate_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of made-up candidates: the part picks the first three labels, the supplier the right one."""
    items = _table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(f"label {i}") for i in range(5)])
    at = lambda c, k: F.get(names, F.pmod(F.col(c) + k, F.lit(5)).cast("int"))
    top = F.array(*[F.struct(at("l_partkey", k).alias("label"), F.lit(0.5 / (k + 1)).alias("probability")) for k in range(3)])
    found = reports.evaluation(items.select(top.alias("top_k"), at("l_suppkey", 0).alias("expected_label")))
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "accuracy_top3")})


_ORDERS = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, CAST(o_orderkey % 3 AS BIGINT) AS high_count, CAST(o_orderkey % 5 AS BIGINT) AS medium_count, CAST(o_orderkey % 7 + 8 AS BIGINT) AS total_clauses FROM orders"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH orders AS (SELECT * FROM {{orders}}) {_ORDERS}", orders=_table(spark, sf_dir, "orders"))


@query(f"SELECT user_id, count(*) AS n_documents, CAST(sum(high_count) AS BIGINT) AS high, CAST(sum(medium_count) AS BIGINT) AS medium, CAST(sum(total_clauses) AS BIGINT) AS clauses FROM ({_ORDERS}) o GROUP BY user_id")
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.portfolio(_stored(spark, sf_dir), "user_id")


@query(f"SELECT * FROM ({_ORDERS}) o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 10")
def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(_stored(spark, sf_dir), 10, by="user_id")


# ---- cleaning ----

_DIRTY = f"""SELECT doc_id, rn, 'Page ' || rn || ' of 9' || chr(10) || replace(line, 'agreement', 'agree-' || chr(10) || 'ment') || '   ' || chr(10) || chr(10) || chr(10) || chr(10)
  || '- ' || rn || ' -' || chr(10) || '  draft ' || chr(10) || 'a  b' || chr(9) || 'c' || chr(10) || rn AS dirty FROM ({contracts.LINES}) l"""


@query(rf"""SELECT doc_id, rn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(dirty, '(\w+)-\n([a-z])', '\1\2', 'g'), chr(10)),
  lambda x: NOT regexp_matches(x, '(?i)^\s*(page\s+\d+\s*(of\s+\d+)?|\d+|-\s*\d+\s*-|confidential|draft)\s*$')), chr(10)), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned
  FROM ({_DIRTY}) d""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyphens, footers and white space of dirtied clauses; without Unicode normalisation, which SQL lacks."""
    dirty = _dirty(spark, sf_dir)
    cleaned = T.collapse_whitespace(T.without_footers(T.join_hyphenated(F.col("dirty"))))
    return dirty.select("doc_id", "rn", cleaned.alias("cleaned"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _DIRTY.replace("chr(10)", "char(10)").replace("chr(9)", "char(9)")
    return spark.sql(f"WITH lineitem AS (SELECT * FROM {{items}}) {sql}", items=_table(spark, sf_dir, "lineitem"))


@query(rf"""SELECT doc_id, rn, array_to_string(list_filter(string_split(dirty, chr(10)),
  lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') NOT IN ('draft', 'a b c', 'Page ' || rn || ' of 9')), chr(10)) AS kept FROM ({{_DIRTY}}) d""".replace("{_DIRTY}", _DIRTY))
def strip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirtied clauses without the lines that are given as repeated, by their keys."""
    known = F.array(F.lit("draft"), F.lit("a b c"), F.concat(F.lit("Page "), F.col("rn").cast("string"), F.lit(" of 9")))
    return _dirty(spark, sf_dir).select("doc_id", "rn", T.without_lines(F.col("dirty"), known).alias("kept"))


@query(f"""SELECT doc_id, rn, text, CAST(start AS INTEGER) AS char_start, CAST(start + length(text) AS INTEGER) AS char_end FROM (
  SELECT doc_id, rn, cleaned AS text, coalesce(sum(length(cleaned)) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM ({ORACLES["clean_lines"]}) c WHERE cleaned <> '') t""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirtied clauses cleaned as the pages of their order, with offsets that run on."""
    pages = _dirty(spark, sf_dir).select("doc_id", F.col("rn").alias("page_number"), F.col("dirty").alias("text"))
    return cleaning.clean_pages(pages).withColumnRenamed("page_number", "rn")


@query()
def clean_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning of all documents, Unicode normalisation included."""
    docs = _table(spark, sf_dir, "documents")
    ligature = F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ"))
    # a generator of one row keeps the cleaning from being written out for each of its two uses
    cleaned = docs.select("doc_id", F.explode(F.array(T.clean_text(ligature))).alias("cleaned"))
    return cleaned.select("doc_id", F.crc32("cleaned").alias("crc32"), F.length("cleaned").alias("n_chars"))


@query(f"SELECT doc_id, rn, line AS cleaned FROM ({contracts.LINES}) l")
def unicode_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with ligatures, full-width letters, raised digits and other spaces put in, cleaned to what they were."""
    dirty = F.col("line")
    for written, found in (("ffi", "\ufb03"), ("fi", "\ufb01"), ("ff", "\ufb00"), ("fl", "\ufb02"), ("S", "\uff33"), ("T", "\uff34"), ("9", "\u2079"), (" the ", "\u00a0the\u3000"), (" of ", "\u2003 of ")):
        dirty = F.replace(dirty, F.lit(written), F.lit(found))
    return contracts.lines(spark, sf_dir).select("doc_id", "rn", T.clean_text(dirty).alias("cleaned"))


@query("""WITH k AS (SELECT DISTINCT source AS doc_id, doc_id AS page, regexp_replace(trim(unnest(string_split(text, chr(10)))), '\\s+', ' ', 'g') AS line FROM documents WHERE text IS NOT NULL),
  n AS (SELECT source AS doc_id, count(*) AS pages FROM documents GROUP BY 1 HAVING count(*) >= 2)
  SELECT doc_id, line, count(*) AS n FROM k JOIN n USING (doc_id) WHERE length(line) > 2 GROUP BY doc_id, line, pages HAVING count(*) >= pages * 0.04""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on at least a twenty-fifth of a source's documents, taking documents as pages."""
    pages = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")
    return cleaning.repeated_line_counts(pages, DEFAULT.with_(min_page_fraction=0.04)).withColumnRenamed("on", "n")


@query("""SELECT o_custkey AS user_id, o_orderkey AS id, o_orderdate AS created_at FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 10""")
def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's list of every user's newest documents, taking orders as documents."""
    orders = _table(spark, sf_dir, "orders")
    held = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("analysis_json"))
    return store.listed(held, 10, by="user_id")


@query("SELECT c_custkey, upper(CASE WHEN contains(c_name, ' ') THEN c_name[1] || string_split(c_name, ' ')[-1][1] ELSE c_name[1:2] END) AS initials, CASE WHEN length(c_name) > 6 THEN c_name[1:6] || '…' ELSE c_name END AS short FROM customer")
def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return _table(spark, sf_dir, "customer").select("c_custkey", T.initials(name).alias("initials"), T.truncated(name, 6).alias("short"))


# ---- vectors ----


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL),
  c AS (SELECT label, list(m ORDER BY d) AS c, sqrt(sum(m * m)) + 1e-12 AS norm FROM m GROUP BY label)
  SELECT vec_id, label, round(s, 5) AS similarity, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS place
  FROM (SELECT vec_id, e.label, list_inner_product(CAST(embedding AS DOUBLE[]), c.c) / norm AS s FROM embeddings e JOIN c USING (label))""")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = vectors.ranked_by_centroid(_table(spark, sf_dir, "embeddings"))
    return ranked.select("vec_id", "label", F.round("similarity_to_centroid", 5).alias("similarity"), "place")


def _bank_sql(per_label: int) -> str:
    """Common tables, the last of them `bank`: exemplar_idx, label, original_index, s, v."""
    return f"""e AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings),
  m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL), c AS (SELECT label, list(m ORDER BY d) AS c, sqrt(sum(m * m)) + 1e-12 AS norm FROM m GROUP BY label),
  s AS MATERIALIZED (SELECT vec_id, v.label, CAST(embedding AS DOUBLE[]) AS v, list_inner_product(CAST(embedding AS DOUBLE[]), c.c) / norm AS s FROM embeddings v JOIN c USING (label)),
  r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS place FROM s),
  walk AS (
    SELECT label, CAST(0 AS BIGINT) AS place, CAST([] AS DOUBLE[][]) AS taken, CAST([] AS BIGINT[]) AS ids FROM c
    UNION ALL
    SELECT label, place, CASE WHEN far THEN list_append(taken, v) ELSE taken END, CASE WHEN far THEN list_append(ids, vec_id) ELSE ids END
    FROM (SELECT w.label, w.taken, w.ids, r.place, r.v, r.vec_id, len(list_filter(w.taken, lambda t: list_inner_product(t, r.v) > 0.85)) = 0 AS far
          FROM walk w JOIN r ON r.label = w.label AND r.place = w.place + 1 WHERE len(w.ids) < {per_label}) next
  ), last AS (SELECT label, arg_max(ids, place) AS ids FROM walk GROUP BY label),
  picked AS (SELECT label, unnest(ids) AS original_index FROM last),
  bank AS (SELECT CAST(row_number() OVER (ORDER BY CAST(b.label AS VARCHAR), s DESC, original_index) - 1 AS INTEGER) AS exemplar_idx, CAST(b.label AS VARCHAR) AS label,
             CAST(original_index AS BIGINT) AS original_index, s, v FROM picked b JOIN r ON r.label = b.label AND r.vec_id = original_index)"""


def _comparison_sql(per_label: int) -> str:
    return f"""WITH RECURSIVE {_bank_sql(per_label)},
  near AS (SELECT e.vec_id, CAST(e.label AS VARCHAR) AS label, b.exemplar_idx, b.label AS found, list_inner_product(CAST(e.embedding AS DOUBLE[]), b.v) AS s FROM embeddings e, bank b),
  placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, exemplar_idx) AS place FROM near)
  SELECT vec_id, round(max(s), 5) AS max_similarity, round(avg(s) FILTER (WHERE place <= 3), 5) AS mean_top3, round(1 - max(s), 5) + 0.0 AS deviation, bool_or(found = label) FILTER (WHERE place = 1) AS agrees
  FROM placed GROUP BY vec_id"""


def _compared(spark: SparkSession, sf_dir: str, per_label: int) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    found = vectors.compared(vectors.nearest(rows, vectors.build_bank(rows, settings=DEFAULT.with_(bank_per_label=per_label))))
    return found.select("vec_id", F.round("max_similarity", 5).alias("max_similarity"), F.round("mean_top3_similarity", 5).alias("mean_top3"), (F.round("deviation", 5) + 0.0).alias("deviation"), "agrees")


@query(_comparison_sql(1))
def nearest_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity, deviation and agreement of all vectors with one exemplar of each label, the nearest to its centroid."""
    return _compared(spark, sf_dir, 1)


@query(_comparison_sql(DEFAULT.bank_per_label))
def bank_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity, deviation and agreement of all vectors with the diverse bank of all labels."""
    return _compared(spark, sf_dir, DEFAULT.bank_per_label)


@query(f"WITH RECURSIVE {_bank_sql(5)} SELECT exemplar_idx, label, original_index, round(s, 5) AS similarity FROM bank")
def exemplar_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = vectors.build_bank(_table(spark, sf_dir, "embeddings"))
    return bank.select("exemplar_idx", "label", "original_index", F.round("similarity_to_centroid", 5).alias("similarity"))


@query(f"""WITH near AS (SELECT q.vec_id, b.vec_id AS exemplar_idx, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0)
  SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, exemplar_idx) AS INTEGER) AS place, exemplar_idx, round(s, 6) AS similarity FROM near
  QUALIFY place <= {DEFAULT.neighbours}""")
def indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors to every vector whose id is divisible by 50, by an index of cells."""
    rows = _table(spark, sf_dir, "embeddings")
    index = cells.build(rows.select(F.col("vec_id").alias("exemplar_idx"), F.col("label").cast("string").alias("label"), F.lit("").alias("text"), "embedding"))
    found = cells.search(rows.where("vec_id % 50 = 0").select("vec_id", "embedding"), index)
    near = found.select("vec_id", F.posexplode("nearest").alias("place", "n"))
    return near.select("vec_id", (F.col("place") + 1).alias("place"), "n.exemplar_idx", F.round("n.similarity", 6).alias("similarity"))


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS place,
  round(max(n) OVER () / min(n) OVER (), 6) AS imbalance FROM n""")
def label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.profile(_table(spark, sf_dir, "embeddings")).withColumn("imbalance", F.round("imbalance", 6))


# ---- model, provider, and the whole ----


def _model_and_bank(spark: SparkSession, sf_dir: str):
    clauses = contracts.clauses(spark, sf_dir).where("NOT skipped AND label IS NOT NULL")
    # written once: training and the bank walk them again and again, and would make the clauses anew each time
    phrases = vectors.checkpointed(clauses.select("text", "label").distinct())
    model = classification.HashedLogistic.fit(phrases)
    embedded = vectors.checkpointed(vectors.embed(phrases).withColumn("vec_id", F.xxhash64("text", "label")))
    return model, vectors.build_bank(embedded, text="text")


@query()
def analyze_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contract from text to summary, with the default model, bank and explanations."""
    model, bank = _model_and_bank(spark, sf_dir)
    # written once, as short and long texts are segmented apart; dealt evenly, as short rows grow
    docs = vectors.checkpointed(contracts.documents(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"))
    found = analysis.responses(analysis.analyze(docs, model, bank))
    return found.select("doc_id", "overall_risk", "summary.*", F.size("clauses").alias("n_clauses"), F.length(F.to_json("clauses")).alias("json_chars"))


@query(f"""{_SCORED} SELECT doc_id, clause_id, risk_level, risk_score,
  CASE WHEN risk_level <> 'low' THEN 'The scorer''s reasons: ' || hint END AS why,
  CASE WHEN risk_level <> 'low' THEN 'template' END AS model_used,
  CASE WHEN risk_level = 'low' THEN 'risk level below threshold' END AS skipped_reason FROM ({HINTED_SQL}) h""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explanation.explain(_scored(spark, sf_dir))
    return _flat(found.select("*", F.col("explanation.text").alias("why"), F.col("explanation.model_used").alias("model_used"), F.col("explanation.skipped_reason").alias("skipped_reason")), "why", "model_used", "skipped_reason")


# ---- extensions ----


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(_table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))

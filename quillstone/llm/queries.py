"""The registered queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, extraction, jaccard, language, media, merkle, minhash, packing, pieces, topk, toxicity, urls
from .shared import table


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, for the byte-level vocabulary of 50k entries."""
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity of 0.75 or more."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=75)


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens along a Hilbert curve."""
    path = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), 1024, 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether decoding them gives the text back.

    A null text counts as empty. `round_trip` compares with the text after the normaliser, which
    takes the mark U+2581 for a space.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pieces.both_ways(docs, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("decoded").alias("decoded_crc32"),
        (F.col("decoded") == F.replace("text", F.lit(pieces.MARK), F.lit(" "))).alias("round_trip"),
    )


#: The rules of the URL query.
URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the URL of every page: the longest rule's, else that of boosted trees."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as an image in archives, read back and described."""
    return media.media_features(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors for every twentieth embedding, by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64.0)


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, after faults were planted in it."""
    return conversations.audited(*conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle digests and proofs of all documents, checked against texts that were tampered with."""
    return merkle.audited(table(spark, sf_dir, "documents"), every=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_curve_packing": op2_curve_packing,
    "op3_main_text": op3_main_text,
    "op4_token_counts": op4_token_counts,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_pieces": op8_pieces,
    "op9_url_filters": op9_url_filters,
    "op10_media_columns": op10_media_columns,
    "op11_circulant_minhash": op11_circulant_minhash,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII string."""
    step = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    """SQL for the digest of a document with this text."""
    parts = (f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


def _climb(n: str, rows: str) -> str:
    """SQL for the trees over `rows` (place, idx, h, n): up, the nodes of all levels, and beside, the siblings of each."""
    return f"""
        {n}up AS (
          SELECT 0 AS lvl, place, idx, h, n FROM {rows}
          UNION ALL
          SELECT lvl + 1, place, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM {n}up WHERE n > 1
          GROUP BY lvl, place, idx // 16, n
        ), {n}beside AS (
          SELECT lvl, place, idx,
                 coalesce(string_agg(h, '') OVER (PARTITION BY lvl, place, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
                 coalesce(string_agg(h, '') OVER (PARTITION BY lvl, place, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs
          FROM {n}up WHERE n > 1
        )"""


def _walk(n: str, rows: str) -> str:
    """SQL for the way of `rows` (rid, place, idx, proof, got) to the top of their tree."""
    return f"""
        {n}walk AS (
          SELECT rid, 0 AS lvl, place, idx, proof, got FROM {rows}
          UNION ALL
          SELECT rid, w.lvl + 1, place, idx // 16, proof || lhs || rhs, sha256(lhs || got || rhs)
          FROM {n}walk w JOIN {n}beside b USING (lvl, place, idx)
        ), {n}end AS (
          SELECT rid, arg_max(proof, lvl) AS proof, arg_max(got, lvl) AS got FROM {n}walk GROUP BY rid
        )"""

#: Only queries that SQL can express have an entry.
ORACLES: dict[str, str] = {
    "op1_jaccard_join": r"""
        WITH RECURSIVE texts AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents
        ), held AS MATERIALIZED (
          SELECT DISTINCT doc_id, unnest(CASE
                   WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                   WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
          FROM texts
        ), sizes AS (
          SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id
        ), shared AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
          FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS MATERIALIZED (
          SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * k >= 75 * (x.n + y.n - k)
        ), steps AS (
          SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
          SELECT doc_id AS a, doc_id AS b FROM documents
          UNION
          SELECT r.a, s.b FROM reached r JOIN steps s ON r.b = s.a
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) c USING (doc_id)
    """,
    "op5_exact_top_k": """
        WITH whole AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score, q.v AS query
          FROM (SELECT DISTINCT vec_id, v FROM whole WHERE vec_id % 20 = 0) q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS place FROM scored
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE rows AS (
          SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || source, '') AS place, {_leaf('text')} AS leaf,
                 CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0
                      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged
          FROM documents
        ), ranked AS (
          SELECT rid, doc_id, place, leaf, coalesce(forged, leaf) AS got, leaf AS h, count(*) OVER (PARTITION BY place) AS n,
                 row_number() OVER (PARTITION BY place ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
          FROM rows
        ), {_climb('s', 'ranked')}, subroots AS (
          SELECT '' AS place, place AS src, h, row_number() OVER (ORDER BY place) - 1 AS idx, count(*) OVER () AS n FROM sup WHERE n = 1
        ), {_climb('t', 'subroots')}, starts AS (
          SELECT rid, place, idx, '' AS proof, got FROM ranked
        ), {_walk('s', 'starts')}, tops AS (
          SELECT rid, u.place, u.idx, e.proof, e.got, u.h FROM send e JOIN ranked r USING (rid) JOIN subroots u ON u.src = r.place
        ), {_walk('t', 'tops')}
        SELECT r.doc_id, r.leaf, u.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.got AS folded_root, e.got = t.h AS verified
        FROM ranked r JOIN tend e USING (rid) JOIN tops u USING (rid) CROSS JOIN (SELECT h FROM tup WHERE n = 1) t
    """,
}

# the same links at another similarity
ORACLES["op11_circulant_minhash"] = f"SELECT *, doc_id = component_id AS kept FROM ({ORACLES['op1_jaccard_join'].replace('>= 75 *', '>= 85 *')})"

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# paths to each state of the grammar (0 begin, 1 system, 2 user, 3 assistant), row by row, with what they cost, their labels and texts
ORACLES["op12_conversation_repair"] = f"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k,
             coalesce('=' || CAST(conv_id AS VARCHAR), '') AS c
      FROM conversations
    ), hurt AS (
      SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM keyed CROSS JOIN (VALUES (0), (1)) copies (copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i, right(rtrim(text, {_WHITE}), 1) AS ending, substr(role, 1, 1) AS initial
      FROM hurt
    ), judged AS (
      SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
             lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
      FROM numbered
    ), grammar (q, letter, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
    ), given AS (
      SELECT q, letter, t, CASE letter WHEN 'u' THEN 'user' ELSE 'assistant' END AS role FROM grammar WHERE letter <> 's'
    ), inserted AS (
      SELECT q, q AS t, 0 AS cost, '' AS audit, '' AS words FROM (VALUES (0), (1), (2), (3)) s (q)
      UNION ALL SELECT q, t, 3, 'I', chr(10) || role || ':' FROM given
      UNION ALL SELECT a.q, b.t, 6, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' FROM given a JOIN given b ON b.q = a.t
    ), paths AS (
      SELECT c, 0 AS i, t AS q, row(cost, audit, words) AS best FROM (SELECT DISTINCT c FROM keyed) CROSS JOIN inserted WHERE inserted.q = 0
      UNION ALL
      SELECT c, i, q, min(best) AS best FROM (
        SELECT c, s.i, n.t AS q, row(s.cost + n.cost, s.audit || n.audit, s.words || n.words) AS best FROM (
          SELECT p.c, j.i, g.t AS q, p.best[1] + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END + e.cost AS cost, p.best[2] || label AS audit,
                 p.best[3] || chr(10) || CASE label WHEN 'K' THEN j.role ELSE CASE g.letter WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || j.text AS words
          FROM paths p JOIN judged j ON j.c = p.c AND j.i = p.i + 1 AND fault IN ('sound', 'truncated')
          JOIN grammar g ON g.q = p.q CROSS JOIN (VALUES ('K', 0), ('R', 3)) e (label, cost)
          WHERE label = 'K' AND g.letter = j.initial OR label = 'R' AND g.letter <> 's'
          UNION ALL
          SELECT p.c, j.i, p.q, p.best[1] + 4, p.best[2] || 'D', p.best[3] FROM paths p JOIN judged j ON j.c = p.c AND j.i = p.i + 1
        ) s JOIN inserted n ON n.q = s.q
      ) GROUP BY c, i, q
    ), ended AS (
      SELECT c, i, min(best) AS best FROM paths WHERE q IN (0, 3) GROUP BY c, i
    ), counted AS (
      SELECT c, max(i) AS i, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM judged GROUP BY c
    )
    SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(best[1] AS BIGINT) AS cost, best[2] AS audit, sha256(substr(best[3], 2)) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, c FROM keyed) k LEFT JOIN counted USING (c) JOIN ended e ON e.c = k.c AND e.i = coalesce(counted.i, 0)
"""

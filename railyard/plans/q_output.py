"""Registered output-guard queries.

Answers are derived from the tables: every ``documents`` row is an answer
(``turn_id = doc_id``, body = text).  The chunks retrieved in that turn are
the top-5 neighbours of vector ``vec_id = turn_id`` (none when there is no
such vector).  Citations: the two nearest retrieved ids, plus an invented
id ``x<turn>`` on every third turn, twice on every sixth.
``enough_context`` is false on every fifth turn, ``needs_human`` true on
every eleventh, and the agent status cycles through the failures on
``turn % 13`` in 1..4.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.operators import output_guards as OG
from railyard.plans import sqlfrag as Q
from railyard.plans.q_search import sql_topk, topk_all
from railyard.plans.registry import register
from railyard.policy import DEFAULT_POLICY, PII_PATTERNS
from railyard.session import materialized
from railyard.sources.tables import table

STATUS = {1: "timeout", 2: "usage_limit_exceeded", 3: "ungrounded_after_retry", 4: "unexpected_error"}


def retrieved(spark, sf):
    """The chunks retrieved in each turn; written once, as callers read them several times."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"))
    h = topk_all(spark, sf, 5)
    return materialized(h.join(d, "id", "left").select(F.col("query_id").alias("turn_id"),
                                                       F.col("id").cast("string").alias("chunk_id"),
                                                       "filename", "distance", "rank"), "retrieved")


def answers(spark, sf, ret=None):
    ret = ret if ret is not None else retrieved(spark, sf)
    d = table(spark, sf, "documents")
    turn = F.col("doc_id")
    good = ret.filter(F.col("rank") <= 2).select("turn_id", (F.col("rank") - 1).alias("pos"), "chunk_id")
    bad = d.filter(turn % 3 == 0).select(turn.alias("turn_id"), F.lit(2).alias("pos"),
                                         F.concat(F.lit("x"), turn.cast("string")).alias("chunk_id"))
    bad2 = d.filter(turn % 6 == 0).select(turn.alias("turn_id"), F.lit(3).alias("pos"),
                                          F.concat(F.lit("x"), turn.cast("string")).alias("chunk_id"))
    cits = good.unionByName(bad).unionByName(bad2).groupBy("turn_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("l"))
    cits = cits.select("turn_id", F.transform("l", lambda x: F.struct(
        x["chunk_id"].alias("chunk_id"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("double").alias("score"))).alias("citations"))
    status = F.coalesce(F.element_at(F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))]),
                                     (turn % 13).cast("int")), F.lit("ok"))
    a = d.select(turn.alias("turn_id"), F.col("text").alias("answer"), (turn % 5 != 0).alias("enough_context"),
                 (turn % 11 == 0).alias("needs_human"), status.alias("agent_status"))
    return a.join(cits, "turn_id", "left").withColumn(
        "citations", F.coalesce("citations", F.array().cast(f"array<{OG.CITATION}>")))


SQL_BASE = f"""
  hits AS ({sql_topk(5)}),
  ret AS (SELECT h.query_id AS turn_id, CAST(h.id AS VARCHAR) AS chunk_id, d.source AS filename, h.distance, h.rank
          FROM hits h LEFT JOIN documents d ON d.doc_id = h.id),
  cit0 AS (SELECT turn_id, rank - 1 AS pos, chunk_id FROM ret WHERE rank <= 2
          UNION ALL SELECT doc_id, 2, 'x' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 = 0
          UNION ALL SELECT doc_id, 3, 'x' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 6 = 0),
  cit AS (SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY pos) - 1 AS pos, chunk_id FROM cit0),
  ans AS (SELECT doc_id AS turn_id, text AS answer, doc_id % 5 <> 0 AS enough_context, doc_id % 11 = 0 AS needs_human,
                 CASE doc_id % 13 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in STATUS.items())} ELSE 'ok' END AS agent_status
          FROM documents),
  cm AS (SELECT c.turn_id, c.pos, c.chunk_id, EXISTS (SELECT 1 FROM ret r WHERE r.turn_id = c.turn_id AND r.chunk_id = c.chunk_id) AS hit
         FROM cit c),
  fc AS (SELECT a.*, coalesce((SELECT string_agg(chunk_id, ',' ORDER BY pos) FROM cm WHERE cm.turn_id = a.turn_id AND hit), '') AS kept_ids,
                coalesce((SELECT string_agg(chunk_id, ',' ORDER BY pos) FROM cm WHERE cm.turn_id = a.turn_id AND NOT hit), '') AS dropped_ids,
                (SELECT count(*) FROM cm WHERE cm.turn_id = a.turn_id AND hit) AS n_kept,
                (SELECT count(*) FROM cm WHERE cm.turn_id = a.turn_id AND NOT hit) AS n_dropped,
                (SELECT count(*) FROM ret WHERE ret.turn_id = a.turn_id) AS n_retrieved
         FROM ans a)"""


def filtered(spark, sf):
    ret = retrieved(spark, sf)
    return OG.filter_citations(answers(spark, sf, ret), ret), ret


def _ids(col):
    return F.array_join(F.transform(col, lambda c: c["chunk_id"]), ",")


@register("filter_citations", sql=f"""
WITH {SQL_BASE} SELECT turn_id, kept_ids, dropped_ids FROM fc""")
def q_filter_citations(spark, sf):
    """Citations kept iff retrieved in the same turn; dropped ids in order."""
    f, _ = filtered(spark, sf)
    return f.select("turn_id", _ids(F.col("citations")).alias("kept_ids"),
                    F.array_join("dropped_citations", ",").alias("dropped_ids"))


@register("is_ungrounded", sql=f"""
WITH {SQL_BASE} SELECT turn_id, enough_context AND n_kept = 0 AS ungrounded FROM fc""")
def q_is_ungrounded(spark, sf):
    """enough_context with no surviving citation."""
    f, _ = filtered(spark, sf)
    return f.select("turn_id", OG.is_ungrounded(F.col("enough_context"), F.col("citations")).alias("ungrounded"))


@register("suppress_body", sql=f"""
WITH {SQL_BASE} SELECT turn_id, NOT enough_context OR (enough_context AND n_kept = 0) AS body_suppressed FROM fc""")
def q_suppress_body(spark, sf):
    """Body replaced by the off-ramp when context is missing or ungrounded."""
    f, _ = filtered(spark, sf)
    return OG.apply_output_guards(f).select("turn_id", "body_suppressed")


_SCRUB_TXT, _SCRUB_COUNTS = Q.sql_pii_scrub("answer")
_MASK_TXT, _MASK_N = Q.sql_profanity_mask(_SCRUB_TXT)
_STAGES_SQL = f"""array_to_string(list_filter([
    CASE WHEN n_dropped > 0 THEN 'citation_integrity' END,
    CASE WHEN enough_context AND n_kept = 0 THEN 'grounding' END,
    CASE WHEN NOT enough_context THEN 'enough_context_false' END,
    CASE WHEN {' + '.join(c for _, c in _SCRUB_COUNTS)} > 0 THEN 'pii_scrub' END,
    CASE WHEN {_MASK_N} > 0 THEN 'profanity_scrub' END], lambda x: x IS NOT NULL), ',')"""


@register("apply_output_guards", sql=f"""
WITH {SQL_BASE}
SELECT turn_id, kept_ids, dropped_ids, enough_context AND n_kept = 0 AS ungrounded,
       NOT enough_context OR (enough_context AND n_kept = 0) AS body_suppressed,
       CASE WHEN NOT enough_context OR n_kept = 0 THEN {Q.q(DEFAULT_POLICY.messages['offramp'])} ELSE {_MASK_TXT} END AS final_body,
       {', '.join(f'{c} AS pii_{label}' for label, c in _SCRUB_COUNTS)},
       {_MASK_N} AS profanity_count, {_STAGES_SQL} AS flagged_stages
FROM fc""")
def q_apply_output_guards(spark, sf):
    """Citations -> grounding -> suppression -> PII scrub -> profanity scrub."""
    f, _ = filtered(spark, sf)
    g = OG.apply_output_guards(f)
    return g.select("turn_id", _ids(F.col("citations")).alias("kept_ids"),
                    F.array_join("dropped_citations", ",").alias("dropped_ids"), "ungrounded", "body_suppressed",
                    "final_body", *[f"pii_{label}" for label, _ in PII_PATTERNS], "profanity_count",
                    F.array_join("flagged_stages", ",").alias("flagged_stages"))


@register("retry_instruction", sql=f"""
WITH {SQL_BASE}
SELECT turn_id, CASE WHEN enough_context AND n_kept = 0 AND n_retrieved = 0 THEN 'retrieve'
                     WHEN enough_context AND n_kept = 0 THEN 'reread' END AS retry FROM fc""")
def q_retry_instruction(spark, sf):
    """Retry kind for grounding failures."""
    f, ret = filtered(spark, sf)
    n = ret.groupBy("turn_id").agg(F.count("*").alias("n_retrieved"))
    g = OG.apply_output_guards(f).join(n, "turn_id", "left")
    return OG.retry_instruction(g).select("turn_id", "retry")


@register("backfill_citations", sql=f"""
WITH {SQL_BASE}
SELECT c.turn_id, c.pos, c.chunk_id, r.filename AS source, round(r.distance, 6) AS score
FROM cit c LEFT JOIN ret r ON r.turn_id = c.turn_id AND r.chunk_id = c.chunk_id
WHERE c.turn_id IN (SELECT turn_id FROM ans)""")
def q_backfill_citations(spark, sf):
    """I8: source and score from the retrieved chunk; unknown ids unchanged."""
    ret = retrieved(spark, sf)
    b = OG.backfill_citations(answers(spark, sf, ret), ret)
    return b.select("turn_id", F.posexplode("citations").alias("pos", "c")).select(
        "turn_id", "pos", F.col("c.chunk_id").alias("chunk_id"), F.col("c.source").alias("source"),
        F.col("c.score").alias("score"))


@register("group_citations", sql=f"""
WITH {SQL_BASE},
bf AS (SELECT c.turn_id, c.pos, c.chunk_id, r.filename AS source, r.distance AS score
       FROM cit c LEFT JOIN ret r ON r.turn_id = c.turn_id AND r.chunk_id = c.chunk_id
       WHERE c.turn_id IN (SELECT turn_id FROM ans))
SELECT turn_id, coalesce(nullif(source, ''), nullif(chunk_id, ''), 'unknown') AS source_key,
       count(*) AS n_citations, round(min(score), 6) AS best_score, min(pos) AS first_pos
FROM bf GROUP BY 1, 2""")
def q_group_citations(spark, sf):
    """Citations grouped by source with count, best score, first position."""
    ret = retrieved(spark, sf)
    b = OG.backfill_citations(answers(spark, sf, ret), ret)
    return OG.group_citations(b)


@register("pretty_source", sql="""
SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'unknown source'
  WHEN regexp_replace(regexp_replace(regexp_replace(url, '(?i)\\.pdf\\.pdf$', '.pdf'),
         '^https?www\\.[^.]+\\.[a-z]{2,}[a-z]*?([A-Z])', '\\1'), '^[/_\\-\\s]+', '') = '' THEN url
  ELSE regexp_replace(regexp_replace(regexp_replace(url, '(?i)\\.pdf\\.pdf$', '.pdf'),
         '^https?www\\.[^.]+\\.[a-z]{2,}[a-z]*?([A-Z])', '\\1'), '^[/_\\-\\s]+', '') END AS display_name
FROM (SELECT page_id, url FROM pages UNION ALL
      SELECT -page_id - 1, regexp_replace(regexp_replace(url, '^(https?)://', '\\1'), '[^A-Za-z0-9.]', '_', 'g') || '.pdf.PDF' FROM pages)""")
def q_pretty_source(spark, sf):
    """Display clean-up of source names (page URLs, raw and as
    URL-derived file names)."""
    p = table(spark, sf, "pages")
    alt = p.select((-F.col("page_id") - 1).alias("page_id"), F.concat(
        F.regexp_replace(F.regexp_replace("url", r"^(https?)://", "$1"), r"[^A-Za-z0-9.]", "_"),
        F.lit(".pdf.PDF")).alias("url"))
    both = p.select("page_id", "url").unionByName(alt)
    return both.select("page_id", OG.pretty_source("url").alias("display_name"))

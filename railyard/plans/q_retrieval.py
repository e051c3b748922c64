"""Registered retrieval-guard queries.

Candidates: top-k neighbours of every ``embeddings`` vector (self excluded),
payload from ``documents`` (``doc_id = vec_id``): text as content, ``source``
as filename, ``lang`` as file type.  Policy: threshold 0.62, top_k 3,
budget 6000 tokens, filenames src0-src15, file types en/fr/de.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.operators import retrieval_guards as RG
from railyard.plans import sqlfrag as Q
from railyard.plans.q_search import emb_queries, sql_topk, topk_all
from railyard.plans.registry import register
from railyard.plans.retrieval import retrieve_knowledge, search_candidates
from railyard.policy import DEFAULT_POLICY, RETRIEVAL_STAGES
from railyard.sources.tables import table

HP = DEFAULT_POLICY.with_(distance_threshold=0.62, top_k=3, max_context_tokens=6000,
                          filename_allowlist=tuple(f"src{i}" for i in range(16)),
                          filetype_allowlist=("en", "fr", "de"))
OVERFETCH = 8


def cands(spark, sf, k=OVERFETCH):
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents")
    return search_candidates(emb_queries(spark, sf), e, k, id_col="vec_id", content="text",
                             filename="source", file_type="lang", exclude_self=True,
                             payload=d, payload_id="doc_id")


def sql_cands(k: int) -> str:
    return f"""
  SELECT h.query_id, h.id AS chunk_id, d.text AS content, h.distance, d.source AS filename,
         d.lang AS file_type, greatest(1, floor(length(coalesce(d.text, '')) / 4))::BIGINT AS token_count
  FROM ({sql_topk(k)}) h LEFT JOIN documents d ON d.doc_id = h.id"""


_FN = "(" + ", ".join(Q.q(x) for x in HP.filename_allowlist) + ")"
_FT = "(" + ", ".join(Q.q(x) for x in HP.filetype_allowlist) + ")"
_W = "(PARTITION BY query_id ORDER BY distance NULLS LAST, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def sql_marked(k: int = OVERFETCH) -> str:
    return sql_marked_from(sql_cands(k))


def sql_marked_from(cands_sql: str) -> str:
    """Stage marking over any candidate relation (query_id, chunk_id,
    content, distance, filename, file_type, token_count)."""
    return f"""
  WITH c AS ({cands_sql}),
  s1 AS (SELECT *, (content IS NULL OR length({Q.sql_ustrip('content')}) = 0) AS empty,
                NOT (coalesce(filename IN {_FN}, FALSE) AND lower(coalesce(file_type, '')) IN {_FT}) AS meta_bad,
                NOT coalesce(distance <= {HP.distance_threshold}, FALSE) AS dist_bad FROM c),
  s2 AS (SELECT *, NOT (empty OR meta_bad OR dist_bad) AS alive3 FROM s1),
  s3 AS (SELECT *, CASE WHEN alive3 THEN sum(alive3::INT) OVER {_W} END AS survivor_rank FROM s2),
  s4 AS (SELECT *, alive3 AND survivor_rank > {HP.top_k} AS topk_bad FROM s3),
  s5 AS (SELECT *, alive3 AND NOT topk_bad AS alive4 FROM s4),
  s6 AS (SELECT *, CASE WHEN alive4 THEN sum(CASE WHEN alive4 THEN token_count ELSE 0 END) OVER {_W} END
                   AS running_tokens FROM s5)
  SELECT *, CASE WHEN empty THEN 'empty' WHEN meta_bad THEN 'metadata' WHEN dist_bad THEN 'distance'
                 WHEN topk_bad THEN 'top_k'
                 WHEN alive4 AND running_tokens > {HP.max_context_tokens} THEN 'token_budget' END AS stage
  FROM s6"""


def sql_guarded(k: int = OVERFETCH) -> str:
    drops = ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS dropped_{s}" for s in RETRIEVAL_STAGES)
    return f"""
  WITH m AS ({sql_marked(k)}),
  a AS (SELECT query_id,
               list(chunk_id ORDER BY distance, chunk_id) FILTER (WHERE stage IS NULL) AS ids,
               coalesce(sum(token_count) FILTER (WHERE stage IS NULL), 0)::BIGINT AS total_context_tokens,
               {drops} FROM m GROUP BY query_id)
  SELECT e.vec_id AS query_id, coalesce(array_to_string(a.ids, ','), '') AS chunk_ids,
         coalesce(len(a.ids), 0) = 0 AS no_context, coalesce(a.total_context_tokens, 0) AS total_context_tokens,
         {', '.join(f'coalesce(a.dropped_{s}, 0) AS dropped_{s}' for s in RETRIEVAL_STAGES)}
  FROM embeddings e LEFT JOIN a ON a.query_id = e.vec_id"""


def guarded(spark, sf, k=OVERFETCH):
    return RG.apply_retrieval_guards(cands(spark, sf, k), emb_queries(spark, sf), HP)


def flat_guarded(g):
    return g.select("query_id", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"),
                    "no_context", "total_context_tokens", *[f"dropped_{s}" for s in RETRIEVAL_STAGES])


@register("drop_empty", sql=f"""
SELECT doc_id FROM documents WHERE NOT (text IS NULL OR length({Q.sql_ustrip('text')}) = 0)""")
def q_drop_empty(spark, sf):
    """H1: keep chunks with non-blank content."""
    d = table(spark, sf, "documents")
    return d.filter(RG.not_empty("text")).select("doc_id")


@register("filter_allowlist", sql=f"""
SELECT doc_id, source AS filename, lang AS file_type FROM documents
WHERE coalesce(source IN {_FN}, FALSE) AND lower(coalesce(lang, '')) IN {_FT}""")
def q_filter_allowlist(spark, sf):
    """H2: filename and case-insensitive file-type allowlists."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("filename"),
                                             F.col("lang").alias("file_type"))
    return d.filter(RG.allowlist_ok(HP))


@register("filter_distance", sql=f"""
SELECT query_id, id, round(distance, 6) AS distance FROM ({sql_topk(5)})
WHERE coalesce(distance <= {HP.distance_threshold}, FALSE)""")
def q_filter_distance(spark, sf):
    """H3: keep hits at or below the threshold."""
    return topk_all(spark, sf, 5).filter(RG.distance_ok(HP)).select("query_id", "id", "distance")


@register("cap_top_k", sql=f"""
SELECT query_id, id AS chunk_id, round(distance, 6) AS distance FROM ({sql_topk(5)}) WHERE rank <= {HP.top_k}""")
def q_cap_top_k(spark, sf):
    """H4: first top_k hits per query."""
    h = topk_all(spark, sf, 5).withColumnRenamed("id", "chunk_id")
    return RG.cap_top_k(h, HP.top_k).select("query_id", "chunk_id", "distance")


@register("token_budget", sql=f"""
SELECT query_id, chunk_id, token_count, running_tokens FROM (
  SELECT query_id, chunk_id, token_count, sum(token_count) OVER {_W} AS running_tokens FROM ({sql_cands(5)}))
WHERE running_tokens <= 2000""")
def q_token_budget(spark, sf):
    """H5: greedy token prefix under a 2000-token budget."""
    c = cands(spark, sf, 5)
    return RG.token_budget(c, 2000).select("query_id", "chunk_id", "token_count", "running_tokens")


@register("apply_retrieval_guards", sql=sql_guarded(OVERFETCH))
def q_apply_retrieval_guards(spark, sf):
    """H6: staged guards with drop accounting per query (search over-fetches 8)."""
    return flat_guarded(guarded(spark, sf, OVERFETCH))


def _sql_context(k: int) -> str:
    return f"""
  WITH m AS ({sql_marked(k)}),
  a AS (SELECT query_id, to_json(list(struct_pack(chunk_id := CAST(chunk_id AS VARCHAR), content := content,
               filename := filename, file_type := file_type, distance := round(distance, 4))
               ORDER BY distance, chunk_id) FILTER (WHERE stage IS NULL)) AS js,
               count(*) FILTER (WHERE stage IS NULL) AS n FROM m GROUP BY query_id)
  SELECT e.vec_id AS query_id, CASE WHEN coalesce(a.n, 0) = 0 THEN 'NO_CONTEXT' ELSE CAST(a.js AS VARCHAR) END AS context
  FROM embeddings e LEFT JOIN a ON a.query_id = e.vec_id"""


@register("format_context", sql=_sql_context(OVERFETCH))
def q_format_context(spark, sf):
    """H7: JSON context per query or NO_CONTEXT."""
    g = guarded(spark, sf, OVERFETCH)
    g = g.withColumn("chunks", F.transform("chunks", lambda c: c.withField(
        "chunk_id", c["chunk_id"].cast("string"))))
    return RG.format_context(g).select("query_id", "context")


@register("retrieve_knowledge", sql=f"""
SELECT g.*, c.context FROM ({sql_guarded(max(HP.top_k, 1))}) g JOIN ({_sql_context(max(HP.top_k, 1))}) c USING (query_id)""")
def q_retrieve_knowledge(spark, sf):
    """H8: search limit max(top_k, 1), then guards and context text."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents")
    r = retrieve_knowledge(emb_queries(spark, sf), e, HP, id_col="vec_id", content="text",
                           filename="source", file_type="lang", exclude_self=True,
                           payload=d, payload_id="doc_id")
    r = r.withColumn("chunks", F.transform("chunks", lambda c: c.withField("chunk_id", c["chunk_id"].cast("string"))))
    r = RG.format_context(r)
    return r.select("query_id", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"),
                    "no_context", "total_context_tokens", *[f"dropped_{s}" for s in RETRIEVAL_STAGES], "context")


@register("latest_retrieval", sql=f"""
WITH calls AS (SELECT query_id AS turn_id, id AS chunk_id,
                      CASE WHEN query_id % 3 = 0 AND rank > 2 THEN 2 ELSE 1 END AS call_no
               FROM ({sql_topk(5)}))
SELECT c.turn_id, c.call_no, c.chunk_id FROM calls c
JOIN (SELECT turn_id, max(call_no) AS call_no FROM calls GROUP BY turn_id) l USING (turn_id, call_no)""")
def q_latest_retrieval(spark, sf):
    """H9: only the last retrieval call of a turn counts (every third turn
    retrieves twice: ranks 1-2, then 3-5)."""
    h = topk_all(spark, sf, 5)
    calls = h.select(F.col("query_id").alias("turn_id"), F.col("id").alias("chunk_id"),
                     F.when((F.col("query_id") % 3 == 0) & (F.col("rank") > 2), 2).otherwise(1).alias("call_no"))
    return RG.latest_retrieval(calls).select("turn_id", "call_no", "chunk_id")


@register("guard_drop_report", sql=f"""
WITH g AS ({sql_guarded(OVERFETCH)})
{' UNION ALL '.join(f"SELECT '{s}' AS stage, sum(dropped_{s})::BIGINT AS dropped FROM g" for s in RETRIEVAL_STAGES)}""")
def q_guard_drop_report(spark, sf):
    """Total drops per stage."""
    return RG.guard_drop_report(guarded(spark, sf, OVERFETCH))

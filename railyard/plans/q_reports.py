"""Registered prompt-input and report queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from railyard.functions.scan import join_same, running
from railyard.functions.text import approx_tokens
from railyard.operators import output_guards as OG
from railyard.operators import reports as R
from railyard.operators.search import search_result_frame
from railyard.plans import sqlfrag as Q
from railyard.plans.q_conversation import SQL_ROUTE_CTES, routed_with_retrieval, turn_frame
from railyard.plans.q_output import SQL_BASE, filtered
from railyard.plans.q_search import sql_topk, topk_all
from railyard.plans.registry import register
from railyard.sources.tables import table


@register("context_json", sql=f"""
SELECT t.query_id, CAST(to_json(list(struct_pack(content := d.text) ORDER BY t.rank)) AS VARCHAR) AS context_json
FROM ({sql_topk(5)}) t JOIN documents d ON d.doc_id = t.id GROUP BY t.query_id""")
def q_context_json(spark, sf):
    """Per question, JSON records of the kept columns that exist
    (content; category is absent from document chunks)."""
    d = table(spark, sf, "documents")
    res = search_result_frame(topk_all(spark, sf, 5), d, "doc_id", "text", {"filename": "source", "file_type": "lang"})
    return R.context_json(res, ["content", "category"])


@register("assemble_prompt", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES},
cx AS (SELECT query_id AS turn_id,
              CAST(to_json(list(struct_pack(content := content) ORDER BY distance, chunk_id)) AS VARCHAR) AS cj
       FROM mk WHERE stage IS NULL GROUP BY query_id)
SELECT tv.conv_id, tv.turn, CAST(to_json([
  struct_pack(role := 'system', content := {Q.q(R.SYSTEM_TEXT)}),
  struct_pack(role := 'user', content := {Q.q(R.QUESTION_HEAD)} || chr(10) || tv.message),
  struct_pack(role := 'assistant', content := {Q.q(R.CONTEXT_HEAD)} || chr(10) || coalesce(cx.cj, '[]'))])
  AS VARCHAR) AS messages
FROM tv LEFT JOIN cx USING (turn_id)""")
def q_assemble_prompt(spark, sf):
    """System, question and retrieved-context messages per user turn."""
    _, retrieved, guarded = routed_with_retrieval(spark, sf, text=True)
    ex = guarded.select(F.col("query_id").alias("turn_id"), F.posexplode("chunks").alias("rank", "c")).select(
        "turn_id", "rank", F.col("c.content").alias("content"))
    cj = R.context_json(ex, ["content", "category"], "turn_id")
    t = turn_frame(spark, sf).select("turn_id", "session_id", "turn", F.col("message").alias("question"))
    p = R.assemble_prompt(t.join(cj, "turn_id", "left"), "question", "context_json")
    return p.select(F.col("session_id").alias("conv_id"), "turn", F.to_json("messages").alias("messages"))


_L1_SQL = f"""
WITH RECURSIVE {SQL_ROUTE_CTES}, ns AS (SELECT turn_id, count(*) AS n FROM sv GROUP BY turn_id),
l1 AS (
SELECT rt.turn_id, rt.conv_id AS session_id, rt.turn, coalesce(refused_reason, 'answered') AS outcome,
       CASE WHEN input_allowed THEN round(d, 6) END AS gate_distance, coalesce(ns.n, 0) AS retrieval_survivors,
       CASE WHEN refused_reason IS NULL THEN n_kept ELSE 0 END AS citations,
       agent_eff = 'ungrounded_after_retry' AS retried,
       CASE WHEN regexp_matches(coalesce(refused_reason, ''), '^(input_guard|conversation_guard|relevance_gate)') THEN 0
            WHEN agent_eff = 'ungrounded_after_retry' THEN 2 ELSE 1 END AS generations,
       (250 + (rt.conv_id % 5) * 700)::BIGINT AS duration_ms
FROM rt LEFT JOIN ns USING (turn_id))"""


def wide(spark, sf):
    """A turn ends 250 ms after it came, and 700 ms later for each fifth of its conversation's number."""
    r, retrieved, _ = routed_with_retrieval(spark, sf)
    t = turn_frame(spark, sf)
    ms = 250 + F.pmod(F.col("session_id"), F.lit(5)) * 700
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + ms * 1000)
    return R.turn_wide_event(r, retrieved, times=t.select("turn_id", F.col("ts").alias("started_at"), end.alias("finished_at")))


@register("turn_wide_event", sql=_L1_SQL + " SELECT * FROM l1")
def q_turn_wide_event(spark, sf):
    """L1: one row per turn joining every stage's output."""
    return wide(spark, sf)


@register("outcome_funnel", sql=_L1_SQL + """
SELECT outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l1 GROUP BY outcome""")
def q_outcome_funnel(spark, sf):
    """L2: turns per outcome and share of all turns."""
    return R.outcome_funnel(wide(spark, sf))


@register("outcome_rollup", sql=_L1_SQL + """,
sc AS (SELECT split_part(outcome, ':', 1) AS stage, nullif(split_part(outcome, ':', 2), '') AS category FROM l1)
SELECT stage, category, count(*) AS n, GROUPING(stage, category) AS level FROM sc GROUP BY ROLLUP (stage, category)""")
def q_outcome_rollup(spark, sf):
    """L2: turns by stage and category with subtotals."""
    return R.outcome_rollup(wide(spark, sf))


@register("stage_survivors", sql=_L1_SQL + f""",
st(place, stage) AS (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(R.STAGES))}),
l2 AS (SELECT coalesce(place, 99) AS out_at FROM l1 LEFT JOIN st ON st.stage = split_part(outcome, ':', 1))
SELECT st.place, st.stage, count(*) FILTER (out_at >= st.place) AS reached, count(*) FILTER (out_at = st.place) AS refused,
       count(*) FILTER (out_at > st.place) AS passed FROM st, l2 GROUP BY st.place, st.stage""")
def q_stage_survivors(spark, sf):
    """L2: turns that reach, fail and pass each stage of the router."""
    return R.stage_survivors(wide(spark, sf))


@register("context_budget", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES},
ht AS (SELECT conv_id, turn, coalesce(sum(greatest(1, floor(length(coalesce(text, '')) / 4))::BIGINT) OVER
         (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS history_tokens
       FROM conversations),
ctx AS (SELECT query_id AS turn_id, sum(token_count) FILTER (WHERE stage IS NULL) AS c FROM mk GROUP BY query_id)
SELECT tv.conv_id, tv.turn, ht.history_tokens::BIGINT AS history_tokens,
       greatest(1, floor(length(coalesce(tv.message, '')) / 4))::BIGINT AS message_tokens,
       coalesce(ctx.c, 0)::BIGINT AS context_tokens, 1024 AS reply_cap,
       (ht.history_tokens + greatest(1, floor(length(coalesce(tv.message, '')) / 4)) + coalesce(ctx.c, 0) + 1024)::BIGINT
         AS total_tokens,
       round((ht.history_tokens + greatest(1, floor(length(coalesce(tv.message, '')) / 4)) + coalesce(ctx.c, 0) + 1024)
             / 128000, 6) AS window_share
FROM tv JOIN ht USING (conv_id, turn) LEFT JOIN ctx USING (turn_id)""")
def q_context_budget(spark, sf):
    """L3: token budget per user turn against a 128k window."""
    _, _, guarded = routed_with_retrieval(spark, sf)
    c = table(spark, sf, "conversations")
    ht = running(c.select("conv_id", "turn", "role", approx_tokens("text").alias("tokens")), ["conv_id"], [F.col("turn")],
                 F.floor(F.col("turn") / 1024).cast("long"), {"history_tokens": ("sum", F.col("tokens"))}, inclusive=False)
    ht = ht.filter(F.col("role") == "user").drop("role", "tokens")
    t = turn_frame(spark, sf).select("turn_id", F.col("session_id").alias("conv_id"), "turn",
                                     approx_tokens("message").alias("message_tokens"))
    t = t.join(ht, ["conv_id", "turn"]).join(
        guarded.select(F.col("query_id").alias("turn_id"), F.col("total_context_tokens").alias("context_tokens")),
        "turn_id", "left").withColumn("context_tokens", F.coalesce("context_tokens", F.lit(0)))
    out = R.context_budget(t)
    return out.select("conv_id", "turn", F.col("history_tokens").cast("long"), "message_tokens", "context_tokens",
                      "reply_cap", "total_tokens", "window_share")


@register("stale_citation_report", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES},
top1 AS (SELECT tv.conv_id, tv.turn, tv.turn_id, sv.chunk_id FROM tv LEFT JOIN sv ON sv.turn_id = tv.turn_id AND sv.srank = 1),
cc AS (SELECT conv_id, turn, turn_id, chunk_id AS own, lag(chunk_id) OVER (PARTITION BY conv_id ORDER BY turn) AS prev
       FROM top1),
cit AS (SELECT conv_id, turn, turn_id, 0 AS p, own AS chunk_id FROM cc WHERE own IS NOT NULL
        UNION ALL SELECT conv_id, turn, turn_id, 1, prev FROM cc WHERE prev IS NOT NULL AND (conv_id + turn) % 4 = 0
        UNION ALL SELECT conv_id, turn, turn_id, 2, 'x' || CAST(turn_id AS VARCHAR) FROM cc WHERE (conv_id + turn) % 3 = 0),
cp AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY p) - 1 AS pos FROM cit),
dr AS (SELECT cp.* FROM cp WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.turn_id = cp.turn_id AND sv.chunk_id = cp.chunk_id)),
rs AS (SELECT DISTINCT tv.conv_id, tv.turn, sv.chunk_id FROM sv JOIN tv USING (turn_id))
SELECT dr.conv_id AS session_id, dr.turn, dr.pos, dr.chunk_id,
       min(rs.turn) AS first_seen_turn, CASE WHEN max(rs.turn) IS NOT NULL THEN 'stale' ELSE 'invented' END AS kind
FROM dr LEFT JOIN rs ON rs.conv_id = dr.conv_id AND rs.chunk_id = dr.chunk_id AND rs.turn < dr.turn
GROUP BY 1, 2, 3, 4""")
def q_stale_citation_report(spark, sf):
    """L4: dropped citations classified as stale (retrieved in an earlier
    turn of the session) or invented.  Every fourth turn also cites the
    previous turn's best chunk."""
    _, retrieved, _ = routed_with_retrieval(spark, sf)
    t = turn_frame(spark, sf).select("turn_id", "session_id", "turn")
    w = Window.partitionBy("turn_id").orderBy("distance", F.col("chunk_id").cast("long"))
    top1 = retrieved.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("turn_id", "chunk_id")
    cc = running(t.join(top1, "turn_id", "left"), ["session_id"], [F.col("turn")],
                 F.floor(F.col("turn") / 1024).cast("long"), {"nth": ("count", F.lit(1))})
    before = cc.select("session_id", (F.col("nth") + 1).alias("nth"), F.col("chunk_id").alias("prev"))
    cc = join_same(cc, before, ["session_id", "nth"], "left").drop("nth")
    k = F.col("session_id") + F.col("turn")
    cits = (cc.filter(F.col("chunk_id").isNotNull()).select("turn_id", "session_id", "turn", F.lit(0).alias("p"), "chunk_id")
            .unionByName(cc.filter(F.col("prev").isNotNull() & (k % 4 == 0)).select(
                "turn_id", "session_id", "turn", F.lit(1).alias("p"), F.col("prev").alias("chunk_id")))
            .unionByName(cc.filter(k % 3 == 0).select(
                "turn_id", "session_id", "turn", F.lit(2).alias("p"),
                F.concat(F.lit("x"), F.col("turn_id").cast("string")).alias("chunk_id"))))
    cits = cits.withColumn("pos", F.row_number().over(Window.partitionBy("turn_id").orderBy("p")) - 1)
    dropped = cits.join(retrieved.select("turn_id", "chunk_id"), ["turn_id", "chunk_id"], "left_anti")
    ret_s = retrieved.join(t, "turn_id").select("session_id", "turn", "chunk_id")
    out = R.stale_citation_report(dropped, ret_s)
    return out.select("session_id", "turn", F.col("pos").cast("long"), "chunk_id", "first_seen_turn", "kind")


@register("repeat_question_report", sql=f"""
SELECT source, doc_id, first_turn, occurrence FROM (
  SELECT source, doc_id,
         row_number() OVER w AS occurrence, first_value(doc_id) OVER w AS first_turn
  FROM (SELECT source, doc_id, sha256(regexp_replace(lower({Q.sql_ustrip('text')}), {Q.q(Q.WS_CLASS + '+')}, ' ', 'g')) AS h
        FROM documents)
  WINDOW w AS (PARTITION BY source, h ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE occurrence > 1""")
def q_repeat_question_report(spark, sf):
    """Texts repeating an earlier one of the same source (session)."""
    d = table(spark, sf, "documents").select("source", "doc_id", "text")
    out = R.repeat_question_report(d, "source", "doc_id", "text")
    return out.select("source", "doc_id", "first_turn", F.col("occurrence").cast("long"))


@register("ungrounded_rate", sql=f"""
WITH {SQL_BASE}
SELECT d.lang, count(*) AS n_turns,
       round(avg(CASE WHEN fc.enough_context AND fc.n_kept = 0 THEN 1.0 ELSE 0.0 END), 6) AS ungrounded_rate,
       round(avg(CASE WHEN NOT fc.enough_context OR fc.n_kept = 0 THEN 1.0 ELSE 0.0 END), 6) AS offramp_rate,
       round(avg(CASE WHEN fc.enough_context AND fc.n_kept = 0 THEN 1.0 ELSE 0.0 END), 6) AS retry_rate
FROM fc JOIN documents d ON d.doc_id = fc.turn_id GROUP BY d.lang""")
def q_ungrounded_rate(spark, sf):
    """Grounding failures, off-ramps and retries per document language."""
    f, ret = filtered(spark, sf)
    n = ret.groupBy("turn_id").agg(F.count("*").alias("n_retrieved"))
    g = OG.retry_instruction(OG.apply_output_guards(f).join(n, "turn_id", "left"))
    g = g.join(table(spark, sf, "documents").select(F.col("doc_id").alias("turn_id"), "lang"), "turn_id")
    return R.ungrounded_rate(g, "lang")

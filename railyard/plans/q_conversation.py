"""Registered conversation queries.

``conversations`` gives sessions (``conv_id``), turns, roles and text;
``events`` gives timed logs (``user_id`` as session).  Small limits make
the rules bind on this data: cap 5 messages, trim 5, transcript 3 lines.

The turn router (J13) runs over every user message.  Derived inputs:
time ``2024-01-01 + conv_id days + turn * (10 + 20 * (conv_id % 4))
minutes`` (so some sessions idle past the 1 h TTL); query vector = the
reversed ``embeddings`` vector ``(conv_id * 8 + turn) % n``; answer = the
next assistant message, citing the best surviving chunk (plus an invented
id every third turn); agent failures, ``enough_context`` and
``needs_human`` cycle on ``conv_id + turn``.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from railyard.functions.scan import hour_bucket
from railyard.functions.text import approx_tokens, ts_text
from railyard.operators import conversation as J
from railyard.operators import output_guards as OG
from railyard.operators.input_guards import mentions_human
from railyard.plans import sqlfrag as Q
from railyard.plans.q_retrieval import HP, sql_guarded, sql_marked_from
from railyard.plans.q_search import topk_all, sql_topk
from railyard.plans.registry import register
from railyard.operators.search import vector_topk_batch
from railyard.plans.retrieval import retrieve_knowledge
from railyard.plans.route import agent_hits, route_turns, surviving_chunks
from railyard.policy import DEFAULT_POLICY
from railyard.session import materialized
from railyard.sources.tables import table

CAP, TRIM, LINES = 5, 5, 3
NOW = "2024-01-29 00:00:00"
RP = HP.with_(max_turns_per_session=3, messages_per_turn=2, session_ttl_seconds=3600)
STATUS = {1: "timeout", 2: "usage_limit_exceeded", 3: "ungrounded_after_retry", 4: "unexpected_error"}
_TOKS = Q.sql_tokens("translate(lower(text), '?,', '  ')")
_KW = "[" + ", ".join(Q.q(w) for w in ("human", "agent", "representative", "manager", "supervisor", "person")) + "]"
SQL_MENTIONS = f"list_has_any({_TOKS}, {_KW})"


def conv(spark, sf):
    return table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")


def ev_messages(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"),
                                             F.col("event_type").alias("role"), F.col("props").alias("text"), "ts")


@register("load_history", sql=f"""
WITH m AS (SELECT user_id AS session_id, event_id AS turn, ts FROM events WHERE ts <= TIMESTAMP '{NOW}'),
l AS (SELECT *, max(ts) OVER (PARTITION BY session_id) AS last,
             row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM m)
SELECT session_id, strftime(max(last), '%Y-%m-%d %H:%M:%S.%f') AS last_write, count(*) AS n_messages,
       string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS history_turns
FROM l WHERE last + INTERVAL {DEFAULT_POLICY.session_ttl_seconds} SECOND > TIMESTAMP '{NOW}'
  AND rn <= {DEFAULT_POLICY.history_cap} GROUP BY session_id""")
def q_load_history(spark, sf):
    """Histories visible at a given time (TTL 1 h from the last write, newest 80)."""
    h = J.load_history(ev_messages(spark, sf), NOW)
    return h.select("session_id", ts_text("last_write").alias("last_write"), "n_messages",
                    F.array_join(F.transform("history", lambda x: x["turn"].cast("string")), ",").alias("history_turns"))


@register("append_history", sql=f"""
SELECT conv_id, turn FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= {TRIM}""")
def q_append_history(spark, sf):
    """Turns 0-3 stored, later turns appended, newest 5 kept."""
    c = conv(spark, sf)
    out = J.append_history(c.filter(F.col("turn") < 4), c.filter(F.col("turn") >= 4), TRIM)
    return out.select(F.col("session_id").alias("conv_id"), "turn")


@register("expire_sessions", sql="""
SELECT user_id, event_id, coalesce(gap >= 3600000000, FALSE) AS new_epoch,
       sum(CASE WHEN gap >= 3600000000 THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
FROM (SELECT user_id, event_id, ts,
             epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)""")
def q_expire_sessions(spark, sf):
    """A gap of at least 1 h since the previous write starts a new epoch."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    out = J.expire_sessions(ev, 3600, "user_id", "ts", ("event_id",))
    return out.select("user_id", "event_id", "new_epoch", "epoch")


@register("clear_sessions", sql="""
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def q_clear_sessions(spark, sf):
    """Delete the sessions listed in another table."""
    ids = table(spark, sf, "labels").filter(F.col("quality") == 0).select("doc_id")
    return J.clear_sessions(conv(spark, sf), ids).select(F.col("session_id").alias("conv_id"), "turn")


@register("session_cap", sql=f"""
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         AS prior_messages,
       count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {CAP} AS capped
FROM conversations""")
def q_session_cap(spark, sf):
    """J5 (isolated): refuse when 5 or more messages are stored."""
    out = J.session_cap(conv(spark, sf), CAP)
    return out.select(F.col("session_id").alias("conv_id"), "turn", "prior_messages", "capped")


_LINE_SQL = ("CASE WHEN role = 'user' THEN 'Customer: ' || coalesce(text, '') "
             "WHEN role = 'assistant' AND length(coalesce(text, '')) > 0 THEN 'Assistant: ' || text END")


@register("render_transcript", sql=f"""
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM (
  SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM (SELECT conv_id, turn, {_LINE_SQL} AS line FROM conversations) WHERE line IS NOT NULL)
WHERE rn <= {LINES} GROUP BY conv_id""")
def q_render_transcript(spark, sf):
    """Last 3 customer/assistant lines per session."""
    out = J.render_transcript(conv(spark, sf), LINES)
    return out.select(F.col("session_id").alias("conv_id"), "transcript")


@register("condenser_input", sql=f"""
SELECT conv_id, turn, len(prev) > 0 AS needs_rewrite,
       CASE WHEN len(prev) > 0 THEN {Q.q(J.TRANSCRIPT_HEAD)} || chr(10) || array_to_string(prev, chr(10)) ||
            chr(10) || chr(10) || {Q.q(J.MESSAGE_HEAD)} || chr(10) || text END AS condenser_prompt,
       text AS gate_query
FROM (SELECT conv_id, turn, role, text,
             coalesce(list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {LINES} PRECEDING AND 1 PRECEDING),
                      []) AS prev
      FROM (SELECT conv_id, turn, role, text, {_LINE_SQL} AS line FROM conversations) WHERE line IS NOT NULL)
WHERE role = 'user'""")
def q_condenser_input(spark, sf):
    """Condenser prompt for follow-ups (first turns pass unchanged)."""
    out = J.condenser_input(conv(spark, sf), LINES)
    return out.select(F.col("session_id").alias("conv_id"), "turn", "needs_rewrite", "condenser_prompt", "gate_query")


@register("mentions_human", sql=f"""
SELECT conv_id, turn, {SQL_MENTIONS} AS mentions_human FROM conversations WHERE role = 'user'""")
def q_mentions_human(spark, sf):
    """Explicit request for a person (whitespace tokens, ? and , blanked)."""
    c = conv(spark, sf).filter(F.col("role") == "user")
    return c.select(F.col("session_id").alias("conv_id"), "turn", mentions_human("text").alias("mentions_human"))


@register("force_escalation", sql=f"""
SELECT conv_id, turn, (conv_id + turn) % 7 = 0 OR {SQL_MENTIONS} AS needs_human
FROM conversations WHERE role = 'user'""")
def q_force_escalation(spark, sf):
    """Model flag (every seventh turn) OR keyword."""
    c = conv(spark, sf).filter(F.col("role") == "user")
    nh = (F.col("session_id") + F.col("turn")) % 7 == 0
    return c.select(F.col("session_id").alias("conv_id"), "turn",
                    J.force_escalation(nh, mentions_human("text")).alias("needs_human"))


@register("repeated_miss_escalation", sql="""
WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS miss FROM events),
i AS (SELECT *, sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM e),
r AS (SELECT *, CASE WHEN miss THEN sum(miss::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS miss_run FROM i)
SELECT user_id, event_id, miss, miss_run::BIGINT AS miss_run, miss_run >= 2 AS force_escalation FROM r""")
def q_repeated_miss(spark, sf):
    """Two consecutive misses (error events) force escalation."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("miss"))
    out = J.repeated_miss_escalation(ev, 2, "user_id", [F.col("ts"), F.col("event_id")], "miss",
                                     bucket=hour_bucket("ts"))
    return out.select("user_id", "event_id", "miss", "miss_run", "force_escalation")


@register("topic_escalation", sql=f"""
SELECT DISTINCT h.query_id AS turn_id FROM ({sql_topk(5)}) h JOIN documents d ON d.doc_id = h.id
WHERE d.source IN (SELECT DISTINCT source FROM documents WHERE lang = 'de')""")
def q_topic_escalation(spark, sf):
    """Turns whose retrieved chunks come from an escalation source
    (sources holding German documents)."""
    d = table(spark, sf, "documents")
    hits = topk_all(spark, sf, 5).join(d.select(F.col("doc_id").alias("id"), F.col("source").alias("filename")), "id")
    topics = d.filter(F.col("lang") == "de").select("source")
    return J.topic_escalation(hits.withColumnRenamed("query_id", "turn_id"), topics, "filename", "turn_id")


# ------------------------------------------------------------------ J13 inputs
def n_vectors(spark, sf) -> int:
    return table(spark, sf, "embeddings").count()


def turn_frame(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    n = n_vectors(spark, sf)
    e = table(spark, sf, "embeddings").select("vec_id", F.reverse("embedding").alias("embedding"))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 86400 +
                             F.col("turn") * (10 + (F.col("conv_id") % 4) * 20) * 60).cast("timestamp_ntz")
    t = c.select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), F.col("conv_id").alias("session_id"),
                 "turn", ts.alias("ts"), F.col("text").alias("message"),
                 ((F.col("conv_id") * 8 + F.col("turn")) % F.lit(n)).alias("vec_id"))
    return t.join(e, "vec_id", "left").drop("vec_id")


def turn_answers(spark, sf, retrieved):
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("answer"))
    k = F.col("conv_id") + F.col("turn")
    status = F.coalesce(F.element_at(F.create_map(*[x for kk, v in STATUS.items() for x in (F.lit(kk), F.lit(v))]),
                                     (k % 17).cast("int")), F.lit("ok"))
    base = u.join(a, ["conv_id", "turn"], "left").select(
        F.concat_ws(":", "conv_id", "turn").alias("turn_id"), F.coalesce("answer", F.lit("")).alias("answer"),
        (k % 5 != 0).alias("enough_context"), (k % 11 == 0).alias("needs_human"), status.alias("agent_status"),
        (k % 3 == 0).alias("__bad"))
    w = Window.partitionBy("turn_id").orderBy("distance", F.col("chunk_id").cast("long"))
    top1 = retrieved.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select(
        "turn_id", F.col("chunk_id").alias("__top"))
    b = base.join(top1, "turn_id", "left")
    cit = lambda x: F.struct(x.alias("chunk_id"), F.lit(None).cast("string").alias("source"),
                             F.lit(None).cast("double").alias("score"))
    cits = F.array_compact(F.array(F.when(F.col("__top").isNotNull(), cit(F.col("__top"))),
                                   F.when(F.col("__bad"), cit(F.concat(F.lit("x"), F.col("turn_id").cast("string"))))))
    return b.withColumn("citations", cits.cast(f"array<{OG.CITATION}>")).drop("__top", "__bad")


def routed(spark, sf):
    return routed_with_retrieval(spark, sf)[0]


def routed_with_retrieval(spark, sf, text=False):
    """(route output, surviving chunks, guarded retrieval) for the turn frame.
    One search of the turn vectors feeds the gate (rank 1) and retrieval; the
    chunks' contents are moved only if the caller asks for ``text``."""
    turns = turn_frame(spark, sf)
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents")
    q = turns.select(F.col("turn_id").alias("query_id"), F.col("embedding").alias("__qv"))
    hits = vector_topk_batch(e, q, max(RP.top_k, 1), id_col="vec_id", query_id="query_id", query_vec="__qv",
                             materialize=True)
    guarded = retrieve_knowledge(q, e, RP, id_col="vec_id", payload=d, payload_id="doc_id", content="text",
                                 filename="source", file_type="lang", hits=hits, materialize=True, text=text)
    retrieved = surviving_chunks(guarded)
    answers = turn_answers(spark, sf, retrieved)
    return route_turns(turns, answers, e, RP, hits=hits, guarded=guarded, id_col="vec_id"), retrieved, guarded


EV_M = Q.sql_evaluate_input("message")
_SCRUB_TXT, _ = Q.sql_pii_scrub("answer")
_MASK_TXT, _ = Q.sql_profanity_mask(_SCRUB_TXT)
_M = RP.messages
_DIST = "list_cosine_distance(tq.qv::DOUBLE[], e.embedding::DOUBLE[])"

SQL_ROUTE_CTES = f"""
  tv AS (SELECT conv_id, turn, concat_ws(':', conv_id, turn) AS turn_id, text AS message,
                TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id AS INTEGER))
                  + to_minutes(CAST(turn * (10 + (conv_id % 4) * 20) AS BIGINT)) AS ts,
                (conv_id * 8 + turn) % (SELECT count(*) FROM embeddings) AS vec_id
         FROM conversations WHERE role = 'user'),
  tq AS (SELECT tv.*, list_reverse(e.embedding) AS qv FROM tv LEFT JOIN embeddings e ON e.vec_id = tv.vec_id),
  gd AS (SELECT tq.turn_id, min({_DIST}) AS d FROM tq JOIN embeddings e ON tq.qv IS NOT NULL GROUP BY tq.turn_id),
  rh AS (SELECT * FROM (SELECT tq.turn_id AS query_id, e.vec_id AS id, {_DIST} AS distance,
                row_number() OVER (PARTITION BY tq.turn_id ORDER BY {_DIST}, e.vec_id) AS rank
                FROM tq JOIN embeddings e ON tq.qv IS NOT NULL) WHERE rank <= {max(RP.top_k, 1)}),
  mk AS ({sql_marked_from('''SELECT h.query_id, h.id AS chunk_id, d.text AS content, h.distance, d.source AS filename,
         d.lang AS file_type, greatest(1, floor(length(coalesce(d.text, '')) / 4))::BIGINT AS token_count
         FROM rh h LEFT JOIN documents d ON d.doc_id = h.id''')}),
  sv AS (SELECT query_id AS turn_id, CAST(chunk_id AS VARCHAR) AS chunk_id, filename, distance,
                row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS srank FROM mk WHERE stage IS NULL),
  an AS (SELECT tv.*, coalesce(a.text, '') AS answer, (tv.conv_id + tv.turn) % 5 <> 0 AS enough_context,
                (tv.conv_id + tv.turn) % 11 = 0 AS ans_human,
                CASE (tv.conv_id + tv.turn) % 17 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in STATUS.items())}
                     ELSE 'ok' END AS agent_status
         FROM tv LEFT JOIN conversations a ON a.conv_id = tv.conv_id AND a.turn = tv.turn + 1 AND a.role = 'assistant'),
  ct AS (SELECT turn_id, 0 AS pos, chunk_id FROM sv WHERE srank = 1
         UNION ALL SELECT turn_id, 1, 'x' || CAST(turn_id AS VARCHAR) FROM tv WHERE (conv_id + turn) % 3 = 0),
  ck AS (SELECT ct.turn_id, string_agg(ct.chunk_id, ',' ORDER BY ct.pos) AS kept, count(*) AS n_kept
         FROM ct JOIN sv ON sv.turn_id = ct.turn_id AND sv.chunk_id = ct.chunk_id GROUP BY ct.turn_id),
  b0 AS (SELECT an.*, gd.d, coalesce(ck.n_kept, 0) AS n_kept, coalesce(ck.kept, '') AS kept,
                {EV_M['allowed']} AS input_allowed, {EV_M['category']} AS input_category, {EV_M['reason']} AS input_reason
         FROM an LEFT JOIN gd USING (turn_id) LEFT JOIN ck USING (turn_id)),
  b1 AS (SELECT *, input_allowed AND NOT coalesce(d <= {RP.distance_threshold}, TRUE) AS gate_refused,
                CASE WHEN agent_status = 'ok' AND enough_context AND n_kept = 0 THEN 'ungrounded_after_retry'
                     ELSE agent_status END AS agent_eff FROM b0),
  ft AS (SELECT *, input_allowed AND NOT gate_refused AND agent_eff = 'ok' AS eligible,
                row_number() OVER (PARTITION BY conv_id ORDER BY ts, turn) AS rk FROM b1),
  walk AS (
    SELECT conv_id, rk, turn_id, input_allowed AND 0 >= {RP.max_turns_per_session} AS capped,
           CASE WHEN input_allowed AND 0 < {RP.max_turns_per_session} AND eligible THEN ts END AS last_ts,
           CASE WHEN input_allowed AND 0 < {RP.max_turns_per_session} AND eligible
                THEN least({RP.messages_per_turn}, {RP.history_cap}) ELSE 0 END::BIGINT AS stored
    FROM ft WHERE rk = 1
    UNION ALL
    SELECT f.conv_id, f.rk, f.turn_id,
           f.input_allowed AND s.s0 >= {RP.max_turns_per_session},
           CASE WHEN f.input_allowed AND s.s0 < {RP.max_turns_per_session} AND f.eligible THEN f.ts ELSE w.last_ts END,
           CASE WHEN f.input_allowed AND s.s0 < {RP.max_turns_per_session} AND f.eligible
                THEN least(s.s0 + {RP.messages_per_turn}, {RP.history_cap}) ELSE s.s0 END::BIGINT
    FROM walk w JOIN ft f ON f.conv_id = w.conv_id AND f.rk = w.rk + 1,
         LATERAL (SELECT CASE WHEN w.stored > 0 AND epoch_us(f.ts) - epoch_us(w.last_ts) >= {RP.session_ttl_seconds * 1000000}
                              THEN 0 ELSE w.stored END AS s0) s),
  rt AS (SELECT ft.*, walk.capped,
                CASE WHEN NOT input_allowed THEN 'input_guard:' || input_category
                     WHEN walk.capped THEN 'conversation_guard:session_cap'
                     WHEN gate_refused THEN 'relevance_gate:out_of_scope'
                     WHEN agent_eff <> 'ok' THEN 'agent:' || agent_eff END AS refused_reason
         FROM ft JOIN walk USING (conv_id, rk))"""

SQL_ROUTE = f"""
WITH RECURSIVE {SQL_ROUTE_CTES}
SELECT conv_id, turn, refused_reason,
       CASE WHEN NOT input_allowed THEN FALSE WHEN capped THEN TRUE WHEN gate_refused THEN FALSE
            WHEN agent_eff <> 'ok' THEN TRUE ELSE ans_human OR {SQL_MENTIONS.replace('text', 'message')} END AS needs_human,
       CASE WHEN refused_reason IS NULL THEN enough_context ELSE FALSE END AS enough_context,
       CASE WHEN NOT input_allowed THEN
              CASE WHEN input_category = 'length' AND contains(input_reason, 'below') THEN {Q.q(_M['length_short'])}
                   WHEN input_category = 'length' THEN {Q.q(_M['length_long'])}
                   WHEN input_category = 'pii' THEN {Q.q(_M['pii'])}
                   WHEN input_category = 'jailbreak' THEN {Q.q(_M['jailbreak'])} ELSE {Q.q(_M['other'])} END
            WHEN capped THEN {Q.q(_M['session_cap'])}
            WHEN gate_refused THEN {Q.q(_M['out_of_scope'])}
            WHEN agent_eff <> 'ok' THEN {Q.q(_M['fallback'])}
            WHEN NOT enough_context THEN {Q.q(_M['offramp'])}
            ELSE {_MASK_TXT} END AS answer,
       CASE WHEN refused_reason IS NULL THEN kept ELSE '' END AS citation_ids,
       CASE WHEN input_allowed THEN round(d, 6) END AS best_distance
FROM rt"""


def route_flat(r):
    return r.select(F.col("session_id").alias("conv_id"), "turn", "refused_reason", "needs_human", "enough_context",
                    "answer", F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",").alias("citation_ids"),
                    "best_distance")


@register("route_turns", sql=SQL_ROUTE)
def q_route_turns(spark, sf):
    """Full decision table per user turn."""
    return route_flat(routed(spark, sf))


SQL_ROUTE_CALLS = SQL_ROUTE.replace("FROM tq JOIN embeddings e ON tq.qv IS NOT NULL) WHERE rank", """
    FROM (SELECT tv.turn_id, CASE WHEN (tv.conv_id + tv.turn) % 3 = 0 THEN e.embedding ELSE list_reverse(e.embedding) END AS qv
          FROM tv LEFT JOIN embeddings e ON e.vec_id = tv.vec_id) tq
    JOIN embeddings e ON tq.qv IS NOT NULL) WHERE rank""")


@register("route_turns_calls", sql=SQL_ROUTE_CALLS)
def q_route_turns_calls(spark, sf):
    """J13 with the agent's own searches: the gate goes by the turn's vector, the
    citations by the last call, which every third turn makes with another vector."""
    turns, e, d = turn_frame(spark, sf), table(spark, sf, "embeddings"), table(spark, sf, "documents")
    first = turns.select("turn_id", F.lit(1).alias("call_no"), "embedding")
    again = turns.filter((F.col("session_id") + F.col("turn")) % 3 == 0).select(
        "turn_id", F.lit(2).alias("call_no"), F.reverse("embedding").alias("embedding"))
    calls = materialized(first.union(again), "calls")
    q = turns.select(F.col("turn_id").alias("query_id"))
    hits = agent_hits(calls, e, max(RP.top_k, 1), "vec_id")
    guarded = retrieve_knowledge(q, e, RP, id_col="vec_id", payload=d, payload_id="doc_id", content="text",
                                 filename="source", file_type="lang", hits=hits, materialize=True, text=False)
    answers = turn_answers(spark, sf, surviving_chunks(guarded))
    return route_flat(route_turns(turns, answers, e, RP, calls=calls, id_col="vec_id", payload=d, payload_id="doc_id",
                                  content="text", filename="source", file_type="lang"))


@register("escalate_on_refusal", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES}
SELECT conv_id, turn, gate_refused, gate_refused AND {SQL_MENTIONS.replace('text', 'message')} AS escalate FROM rt""")
def q_escalate_on_refusal(spark, sf):
    """Keyword escalation applied to gate-refused turns too."""
    r = routed(spark, sf).join(turn_frame(spark, sf).select("turn_id", "message"), "turn_id")
    return r.select(F.col("session_id").alias("conv_id"), "turn", "gate_refused",
                    (F.col("gate_refused") & mentions_human("message")).alias("escalate"))


@register("refusal_label", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES}
SELECT conv_id, turn, CASE WHEN refused_reason IS NULL OR refused_reason = '' THEN NULL
  WHEN starts_with(refused_reason, 'input_guard:jailbreak') THEN 'input_guard / jailbreak'
  WHEN starts_with(refused_reason, 'input_guard:pii') THEN 'input_guard / pii'
  WHEN starts_with(refused_reason, 'input_guard:length') THEN 'input_guard / length'
  ELSE CASE WHEN split_part(refused_reason, ':', 1) = 'agent' OR starts_with(refused_reason, 'input_guard')
                 OR starts_with(refused_reason, 'relevance_gate') OR starts_with(refused_reason, 'conversation_guard')
            THEN regexp_extract(refused_reason, '^(agent|input_guard|relevance_gate|conversation_guard)')
            ELSE refused_reason END END AS label FROM rt""")
def q_refusal_label(spark, sf):
    """Readable label per refused turn."""
    r = routed(spark, sf)
    return r.select(F.col("session_id").alias("conv_id"), "turn", J.refusal_label("refused_reason").alias("label"))


@register("persist_only_success", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES}
SELECT conv_id, turn FROM rt WHERE refused_reason IS NULL""")
def q_persist_only_success(spark, sf):
    """Only successful turns enter the history."""
    r = routed(spark, sf)
    return r.filter(F.col("refused_reason").isNull()).select(F.col("session_id").alias("conv_id"), "turn")


@register("escalation_queue", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES},
q AS (SELECT CASE WHEN capped THEN 'session_cap' WHEN agent_eff <> 'ok' THEN 'agent:' || agent_eff
                  WHEN ans_human THEN 'model' ELSE 'keyword' END AS reason
      FROM rt WHERE input_allowed AND (capped OR (NOT gate_refused AND (agent_eff <> 'ok' OR ans_human
            OR {SQL_MENTIONS.replace('text', 'message')}))))
SELECT reason, count(*) AS n FROM q GROUP BY reason""")
def q_escalation_queue(spark, sf):
    """Escalation signals counted by reason."""
    signals = J.escalation_signals(routed(spark, sf).join(turn_answers_flags(spark, sf), "turn_id", "left"))
    return signals.groupBy("reason").agg(F.count("*").alias("n"))


@register("escalation_signals", sql=f"""
WITH RECURSIVE {SQL_ROUTE_CTES}
SELECT conv_id, turn, CASE WHEN capped THEN 'session_cap' WHEN agent_eff <> 'ok' THEN 'agent:' || agent_eff
                           WHEN ans_human THEN 'model' ELSE 'keyword' END AS reason, md5(message) AS message_md5
FROM rt WHERE input_allowed AND (capped OR (NOT gate_refused AND (agent_eff <> 'ok' OR ans_human
      OR {SQL_MENTIONS.replace('text', 'message')})))""")
def q_escalation_signals(spark, sf):
    """One row per turn handed to a person: session, turn, reason and message."""
    signals = J.escalation_signals(routed(spark, sf).join(turn_answers_flags(spark, sf), "turn_id", "left"))
    msgs = turn_frame(spark, sf).select("turn_id", "message")
    return signals.join(msgs, "turn_id").select(F.col("session_id").alias("conv_id"), "turn", "reason",
                                                F.md5("message").alias("message_md5"))


def turn_answers_flags(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"),
                    ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("ans_human"))


@register("handoff_matrix", sql=f"""
WITH g AS (
  SELECT d.doc_id AS turn_id, coalesce(r.no_context, TRUE) AS no_context, d.doc_id % 5 <> 0 AS enough_context,
         d.doc_id % 11 = 0 AS needs_human
  FROM documents d LEFT JOIN (SELECT query_id, chunk_ids = '' AS no_context FROM (
       {sql_guarded(max(HP.top_k, 1))})) r
    ON r.query_id = d.doc_id)
SELECT turn_id, CASE WHEN no_context THEN 'out_of_scope' WHEN NOT enough_context THEN 'soft_offramp'
                     WHEN needs_human THEN 'handoff' ELSE 'answer' END AS outcome,
       NOT no_context AS model_called FROM g""")
def q_handoff_matrix(spark, sf):
    """Outcome per answer turn from no_context (guarded retrieval),
    refuse_when_no_context, enough_context and needs_human."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    g = retrieve_knowledge(q, e, HP, id_col="vec_id", payload=d, payload_id="doc_id", content="text",
                           filename="source", file_type="lang", exclude_self=True)
    t = d.select(F.col("doc_id").alias("turn_id")).join(
        g.select(F.col("query_id").alias("turn_id"), "no_context"), "turn_id", "left")
    outcome, called = J.handoff_outcome(F.coalesce("no_context", F.lit(True)), True,
                                        F.col("turn_id") % 5 != 0, F.col("turn_id") % 11 == 0)
    return t.select("turn_id", outcome.alias("outcome"), called.alias("model_called"))


@register("trim_history_tokens", sql="""
SELECT conv_id, turn, running_tokens FROM (
  SELECT conv_id, turn, sum(greatest(1, floor(length(coalesce(text, '')) / 4))::BIGINT) OVER
         (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_tokens
  FROM conversations) WHERE running_tokens <= 500""")
def q_trim_history_tokens(spark, sf):
    """Newest messages within a 500-token budget."""
    c = conv(spark, sf).withColumn("tokens", approx_tokens("text"))
    out = J.trim_history_tokens(c, 500)
    return out.select(F.col("session_id").alias("conv_id"), "turn", F.col("running_tokens").cast("long"))

"""Turn router (J13): one plan that decides every turn's outcome.

Order (first hit wins): input guard -> session cap -> relevance gate ->
agent outcome -> escalation -> response.  Model calls stay outside: their
results arrive as an ``answers`` table keyed by ``turn_id``.

Plan shape: the input guards are one projection; the gate and retrieval
search only turns that passed the input guards (numpy blocks against the
scanned corpus, see ``operators.search``); answers, gate and retrieval are
equi-joins on ``turn_id``; the session rules are one window pass plus a
bounded fold per session piece (``operators.conversation.session_fold``).
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, functions as F

from railyard.operators import output_guards as OG
from railyard.operators.conversation import force_escalation, session_fold
from railyard.operators.gate import gate_from_hits
from railyard.operators.search import vector_topk_batch
from railyard.operators.retrieval_guards import latest_retrieval
from railyard.operators.input_guards import evaluate_input, mentions_human, refusal_message
from railyard.plans.retrieval import retrieve_knowledge
from railyard.policy import DEFAULT_POLICY, Policy
from railyard.session import materialized


def surviving_chunks(guarded: DataFrame) -> DataFrame:
    """Long frame ``turn_id, chunk_id, filename, distance`` of the chunks
    that passed the retrieval guards (the valid citation set per turn)."""
    return guarded.select(F.col("query_id").alias("turn_id"), F.explode("chunks").alias("c")).select(
        "turn_id", F.col("c.chunk_id").cast("string").alias("chunk_id"), F.col("c.filename").alias("filename"),
        F.col("c.distance").alias("distance"))


def agent_hits(calls: DataFrame, corpus: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Top-k hits of the last retrieval call of each turn; earlier calls are
    replaced by it and not searched at all."""
    last = latest_retrieval(calls).select(F.col("turn_id").alias("query_id"), F.col("embedding").alias("__qv"))
    return vector_topk_batch(corpus, last, k, id_col=id_col, vec_col=vec_col, query_id="query_id", query_vec="__qv",
                             materialize=True)


def route_turns(turns: DataFrame, answers: DataFrame, corpus: DataFrame, policy: Policy = DEFAULT_POLICY, *,
                hits: Optional[DataFrame] = None, guarded: Optional[DataFrame] = None,
                calls: Optional[DataFrame] = None,
                id_col: str = "id", vec_col: str = "embedding",
                payload: Optional[DataFrame] = None, payload_id: Optional[str] = None,
                content: str = "content", filename: str = "filename", file_type: str = "file_type") -> DataFrame:
    """J13.

    ``turns``: ``turn_id, session_id, turn, ts, message, embedding``.
    ``answers``: ``turn_id, answer, citations array<struct<chunk_id,source,score>>,
    enough_context, needs_human, agent_status`` ("ok" or one of
    ``AGENT_FAILURES``).  ``hits``: the unfiltered top-k search of the turn
    vectors (``query_id = turn_id``), for the gate: its rank-1 distance counts.
    ``calls``: the searches the agent made on its own, ``turn_id, call_no,
    embedding``; only a turn's last call is searched, and its result is what the
    answer may cite.  Without ``calls`` the retrieval guards read ``hits``, so
    one search serves both.  ``guarded``: the retrieval-guard result per turn
    (``query_id, chunks``); computed with :func:`retrieve_knowledge` when not given.
    """
    msgs = policy.messages
    t = evaluate_input(turns, "message", policy)
    ok_q = t.filter(F.col("input_allowed")).select(F.col("turn_id").alias("query_id"),
                                                    F.col("embedding").alias("__qv"))
    if hits is None:
        ok_q = materialized(ok_q, "asked")  # the guards run once, though several steps read the turns
        hits = vector_topk_batch(corpus, ok_q, max(policy.top_k, 1), id_col=id_col, vec_col=vec_col,
                                 query_id="query_id", query_vec="__qv", materialize=True)
    gate = gate_from_hits(ok_q, hits, policy).withColumnRenamed("query_id", "turn_id")
    if guarded is None:
        if calls is not None:
            hits = agent_hits(calls.join(ok_q.select(F.col("query_id").alias("turn_id")), "turn_id", "left_semi"), corpus,
                              max(policy.top_k, 1), id_col, vec_col)
        guarded = retrieve_knowledge(ok_q, corpus, policy, id_col=id_col, vec_col=vec_col, payload=payload,
                                     payload_id=payload_id, content=content, filename=filename,
                                     file_type=file_type, hits=hits, text=False)
    valid = guarded.select(F.col("query_id").alias("turn_id"), "chunks")
    guarded_ans = OG.apply_output_guards(OG.check_citations_inline(answers, valid), policy)
    t = t.join(gate, "turn_id", "left").join(
        guarded_ans.select("turn_id", F.col("citations").alias("out_citations"), "final_body", "ungrounded",
                           F.col("enough_context").alias("ans_enough"), F.col("needs_human").alias("ans_human"),
                           "agent_status"), "turn_id", "left")
    gate_refused = F.col("input_allowed") & ~F.coalesce(F.col("gate_allowed"), F.lit(True)) & F.lit(
        policy.refuse_when_no_context)
    status = F.coalesce(F.col("agent_status"), F.lit("unexpected_error"))
    status = F.when((status == "ok") & F.coalesce(F.col("ungrounded"), F.lit(False)),
                    F.lit("ungrounded_after_retry")).otherwise(status)
    t = t.withColumns({"gate_refused": gate_refused, "agent_outcome": status, "input_ok": F.col("input_allowed"),
                       "eligible": F.col("input_allowed") & ~gate_refused & (status == "ok")})
    t = session_fold(t, policy, "session_id", "turn", "ts", "input_ok", "eligible")
    refused = (F.when(~F.col("input_allowed"), F.concat(F.lit("input_guard:"), F.col("input_category")))
               .when(F.col("capped"), F.lit("conversation_guard:session_cap"))
               .when(F.col("gate_refused"), F.lit("relevance_gate:out_of_scope"))
               .when(F.col("agent_outcome") != "ok", F.concat(F.lit("agent:"), F.col("agent_outcome"))))
    t = t.withColumn("refused_reason", refused)
    success = F.col("refused_reason").isNull()
    needs_human = (F.when(~F.col("input_allowed"), F.lit(False)).when(F.col("capped"), F.lit(True))
                   .when(F.col("gate_refused"), F.lit(False)).when(F.col("agent_outcome") != "ok", F.lit(True))
                   .otherwise(force_escalation(F.col("ans_human"), mentions_human("message"))))
    answer = (F.when(~F.col("input_allowed"), refusal_message(F.col("input_allowed"), F.col("input_category"),
                                                              F.col("input_reason"), policy))
              .when(F.col("capped"), F.lit(msgs["session_cap"]))
              .when(F.col("gate_refused"), F.lit(msgs["out_of_scope"]))
              .when(F.col("agent_outcome") != "ok", F.lit(msgs["fallback"]))
              .otherwise(F.col("final_body")))
    empty = F.array().cast(f"array<{OG.CITATION}>")
    return t.select(
        "turn_id", "session_id", "turn", "refused_reason", needs_human.alias("needs_human"),
        F.when(success, F.col("ans_enough")).otherwise(F.lit(False)).alias("enough_context"),
        answer.alias("answer"),
        F.when(success, F.coalesce("out_citations", empty)).otherwise(empty).alias("citations"),
        "best_distance", "input_category", "gate_refused", "agent_outcome", "capped",
        F.col("input_flagged").alias("input_flagged"))

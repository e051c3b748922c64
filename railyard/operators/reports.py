"""Prompt inputs and turn analytics.

Reports are aggregations over per-turn frames: partial aggregation happens
map-side, and shares use a window over the already-aggregated rows only.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from railyard.functions.text import ustrip
from railyard.policy import WS_CLASS

SYSTEM_TEXT = "Answer the question using only the retrieved information. Say so when it is not enough."
QUESTION_HEAD, CONTEXT_HEAD = "[question]", "[chunks]"


def context_json(results: DataFrame, keep: Sequence[str], query_col: str = "query_id",
                 order_col: str = "rank") -> DataFrame:
    """Per question, a JSON array of records holding only the listed
    columns that exist (in result order)."""
    cols = [c for c in keep if c in results.columns]
    rec = F.struct(F.col(order_col).alias("__o"), *[F.col(c) for c in cols])
    agg = results.groupBy(query_col).agg(F.array_sort(F.collect_list(rec)).alias("__r"))
    return agg.select(query_col, F.to_json(F.transform("__r", lambda r: r.dropFields("__o")),
                                           {"ignoreNullFields": "false"}).alias("context_json"))


def assemble_prompt(df: DataFrame, question: str = "question", context: str = "context_json",
                    system_text: str = SYSTEM_TEXT, question_head: str = QUESTION_HEAD,
                    context_head: str = CONTEXT_HEAD) -> DataFrame:
    """Chat messages (system, user question, retrieved context) as an
    ``array<struct<role, content>>`` column ``messages``."""
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return df.withColumn("messages", F.array(
        msg("system", F.lit(system_text)),
        msg("user", F.concat(F.lit(question_head + "\n"), F.col(question))),
        msg("assistant", F.concat(F.lit(context_head + "\n"), F.coalesce(F.col(context), F.lit("[]"))))))


def turn_wide_event(routed: DataFrame, survivors: DataFrame, turn_col: str = "turn_id",
                    times: DataFrame | None = None) -> DataFrame:
    """L1: one row per turn with outcome, gate distance, survivors,
    citations and generation count (2 when a grounding retry happened).

    ``times`` (``turn_col, started_at, finished_at``) adds ``duration_ms``, null
    for a turn that it does not hold or that has not finished."""
    n_surv = survivors.groupBy(turn_col).agg(F.count("*").alias("retrieval_survivors"))
    out = routed.join(n_surv, turn_col, "left")
    extra = []
    if times is not None:
        us = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("finished_at", "started_at")]
        out = out.join(times.select(turn_col, F.floor((us[0] - us[1]) / 1000).alias("duration_ms")), turn_col, "left")
        extra = ["duration_ms"]
    retried = F.col("agent_outcome") == "ungrounded_after_retry"
    return out.select(
        turn_col, "session_id", "turn", F.coalesce("refused_reason", F.lit("answered")).alias("outcome"),
        F.col("best_distance").alias("gate_distance"),
        F.coalesce("retrieval_survivors", F.lit(0)).cast("long").alias("retrieval_survivors"),
        F.size("citations").cast("long").alias("citations"), retried.alias("retried"),
        F.when(F.coalesce(F.col("refused_reason"), F.lit("")).rlike("^(input_guard|conversation_guard|relevance_gate)"),
               F.lit(0))
        .when(retried, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("generations"), *extra)


def outcome_funnel(events: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """L2: turns per outcome and their share of all turns."""
    g = events.groupBy(outcome_col).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def outcome_rollup(events: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """L2: turns by ``rollup(stage, category)`` of the outcome; ``level`` is 0 for a
    (stage, category), 1 for a stage and 3 for all turns."""
    stage, category = (F.split_part(outcome_col, F.lit(":"), F.lit(i)) for i in (1, 2))
    df = events.select(stage.alias("stage"), F.nullif(category, F.lit("")).alias("category"))
    return df.rollup("stage", "category").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


#: The router's stages, in the order in which a turn meets them.
STAGES = ("input_guard", "conversation_guard", "relevance_gate", "agent")


def stage_survivors(events: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """L2: for each stage the turns that reach it, that it refuses and that go on.
    One aggregation whatever the number of stages."""
    stage = F.split_part(outcome_col, F.lit(":"), F.lit(1))
    wide = events.agg(F.count("*").alias("all"), *[F.count(F.when(stage == s, 1)).alias(f"r{i}") for i, s in enumerate(STAGES)])
    rows, before = [], "all"
    for i, s in enumerate(STAGES):
        rows.append(f"{i}, '{s}', {before}, r{i}, {before} - r{i}")
        before += f" - r{i}"
    return wide.selectExpr(f"stack({len(STAGES)}, {', '.join(rows)}) AS (place, stage, reached, refused, passed)")


def context_budget(turns: DataFrame, window_tokens: int = 128000, reply_cap: int = 1024) -> DataFrame:
    """L3: history + message + retrieved context + reply cap per turn, and
    the share of the model window."""
    total = F.col("history_tokens") + F.col("message_tokens") + F.col("context_tokens") + F.lit(reply_cap)
    return (turns.withColumn("reply_cap", F.lit(reply_cap).cast("long"))
            .withColumn("total_tokens", total.cast("long"))
            .withColumn("window_share", F.col("total_tokens") / F.lit(window_tokens)))


def stale_citation_report(dropped: DataFrame, retrieved: DataFrame, session_col: str = "session_id",
                          turn_col: str = "turn") -> DataFrame:
    """L4: a dropped citation is *stale* when its chunk was retrieved in an
    earlier turn of the same session, else *invented*.  Equi-join on
    (session, chunk) plus the range predicate on the turn."""
    r = retrieved.select(F.col(session_col).alias("__s"), F.col("chunk_id").alias("__c"),
                         F.col(turn_col).alias("__t")).distinct()
    j = dropped.join(r, dropped[session_col].eqNullSafe(r["__s"]) & (dropped["chunk_id"] == r["__c"])
                     & (r["__t"] < dropped[turn_col]), "left")
    g = j.groupBy(session_col, turn_col, "pos", "chunk_id").agg(F.min(F.col("__t")).alias("first_seen_turn"))
    return g.withColumn("kind", F.when(F.col("first_seen_turn").isNotNull(), F.lit("stale"))
                        .otherwise(F.lit("invented")))


def normalize_question(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(ustrip(c)), WS_CLASS + "+", " ")


def repeat_question_report(messages: DataFrame, session_col: str, turn_col: str, text_col: str,
                           bucket_size: int = 1024) -> DataFrame:
    """Messages repeating an earlier message of the same session (after
    case and whitespace normalisation).  The occurrence number is a
    two-level count and the first turn a partial aggregate, so one question
    repeated a million times is not one task."""
    from railyard.functions.scan import join_same, running
    df = messages.withColumn("__sha", F.sha2(normalize_question(text_col), 256))
    bucket = F.floor(F.col(turn_col) / F.lit(bucket_size)).cast("long")
    df = running(df, [session_col, "__sha"], [F.col(turn_col)], bucket, {"occurrence": ("count", F.lit(1))})
    first = df.groupBy(session_col, "__sha").agg(F.min(turn_col).alias("first_turn"))
    return (join_same(df.filter(F.col("occurrence") > 1), first, [session_col, "__sha"])
            .withColumn("occurrence", F.col("occurrence").cast("long")).drop("__sha"))


def ungrounded_rate(guarded: DataFrame, group_col: str) -> DataFrame:
    """Share of turns with grounding failures, off-ramps and retries."""
    return guarded.groupBy(group_col).agg(
        F.count("*").alias("n_turns"),
        F.avg(F.col("ungrounded").cast("double")).alias("ungrounded_rate"),
        F.avg(F.col("body_suppressed").cast("double")).alias("offramp_rate"),
        F.avg(F.col("retry").isNotNull().cast("double")).alias("retry_rate"))

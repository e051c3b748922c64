"""Conversation state and turn rules (B9, J1-J12, J14-J18) as windows,
joins and bounded per-session arrays.

Histories are trimmed with ``row_number`` *before* anything is collected,
so a per-session array never holds more than the cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from railyard.functions.orbit import orbit
from railyard.functions.scan import hour_bucket, join_same, previous, running
from railyard.functions.text import Counter, is_blank, token_count, ustrip
from railyard.policy import DEFAULT_POLICY, WS_CLASS, Policy
from railyard.session import materialized


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------- B9
_HEX_INT = rf"^{WS_CLASS}*\+?(0[xX]_?)?[0-9A-Fa-f](_?[0-9A-Fa-f])*{WS_CLASS}*$"


def uuid_valid(col) -> Column:
    """Accepts what Python's ``UUID(text)`` accepts: ``urn:``/``uuid:``
    prefixes, braces, dashes anywhere, then 32 characters parsed as hex."""
    s = F.replace(F.replace(F.coalesce(_c(col), F.lit("")), F.lit("urn:"), F.lit("")),
                  F.lit("uuid:"), F.lit(""))
    s = F.replace(F.btrim(s, F.lit("{}")), F.lit("-"), F.lit(""))
    return (F.length(s) == 32) & s.rlike(_HEX_INT) & _c(col).isNotNull()


def session_id_from_conv(conv_id) -> Column:
    """Derived session ids in four shapes (undashed, dashed, braced, invalid)."""
    h = F.md5(_c(conv_id).cast("string"))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                         F.substring(h, 17, 4), F.substring(h, 21, 12))
    k = F.pmod(_c(conv_id), F.lit(4))
    return (F.when(k == 0, h).when(k == 1, dashed)
            .when(k == 2, F.concat(F.lit("{"), dashed, F.lit("}")))
            .otherwise(F.concat(F.lit("conv-"), _c(conv_id).cast("string"))))


def validate_turns(df: DataFrame, session_col: str = "session_id", msg_col: str = "message") -> DataFrame:
    """Split-ready flag plus the first failing field's reason."""
    ok_sid = uuid_valid(session_col)
    blank = is_blank(msg_col)
    reason = (F.when(~ok_sid, F.lit("session_id must be a valid UUID"))
              .when(blank, F.lit("message must not be empty or whitespace-only")))
    return df.withColumn("valid", ok_sid & ~blank).withColumn("reject_reason", reason)


# ----------------------------------------------------------------- J1 - J4
def _session_window(session_col: str, order_col: str, desc: bool = False):
    o = F.col(order_col).desc() if desc else F.col(order_col).asc()
    return Window.partitionBy(session_col).orderBy(o)


def load_history(messages: DataFrame, now: str, policy: Policy = DEFAULT_POLICY, session_col: str = "session_id",
                 turn_col: str = "turn", ts_col: str = "ts") -> DataFrame:
    """Per session, the stored history visible at ``now``: writes after
    ``now`` are not yet there, a session idle for the TTL since its last
    write is gone, and at most ``history_cap`` newest messages are kept.
    The cap is applied with ``row_number`` before anything is collected."""
    now_c = F.lit(now).cast("timestamp_ntz")
    m = messages.filter(F.col(ts_col) <= now_c)
    # newest messages first; ``row_number() <= cap`` gets a partial
    # WindowGroupLimit before the shuffle, so a hot session ships <= cap rows
    trimmed = (m.withColumn("__rn", F.row_number().over(_session_window(session_col, turn_col, desc=True)))
               .filter(F.col("__rn") <= policy.history_cap))
    # last write per session: map-side partial aggregation, no session window
    alive = (m.groupBy(session_col).agg(F.max(ts_col).alias("last_write"))
             .filter(F.col("last_write") + F.make_interval(secs=F.lit(policy.session_ttl_seconds)) > now_c))
    return join_same(trimmed, alive, [session_col]).groupBy(session_col).agg(
        F.max("last_write").alias("last_write"),
        F.count("*").alias("n_messages"),
        F.array_sort(F.collect_list(F.struct(turn_col, "role", "text"))).alias("history"))


def append_history(current: DataFrame, new: DataFrame, cap: int, session_col: str = "session_id",
                   turn_col: str = "turn") -> DataFrame:
    """Concatenate and keep the ``cap`` most recent messages per session.
    Sessions without new messages are untouched (no refresh). Messages of one
    turn go by a hash of their columns, so reruns agree."""
    both = current.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(session_col).orderBy(F.col(turn_col).desc(), F.xxhash64(*both.columns))
    return both.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= cap).drop("__rn")


def expire_sessions(messages: DataFrame, ttl_seconds: int, session_col: str = "session_id",
                    ts_col: str = "ts", order_cols: tuple = ()) -> DataFrame:
    """A gap of at least the TTL since the previous write starts a new
    epoch (fresh, empty history).  ``epoch`` counts from 0 per session.

    Hot sessions are split by hour: the previous write and the running
    epoch count are two-level scans (see ``functions.scan``)."""
    order = [F.col(ts_col), *[F.col(c) for c in order_cols]]
    bucket = hour_bucket(ts_col)
    df = messages.withColumn("__us", F.unix_micros(F.col(ts_col).cast("timestamp")))
    df = previous(df, [session_col], order, bucket, "__us", "__prev_us")
    flag = F.coalesce((F.col("__us") - F.col("__prev_us")) >= F.lit(ttl_seconds * 1_000_000), F.lit(False))
    df = df.withColumn("new_epoch", flag)
    df = running(df, [session_col], order, bucket, {"epoch": ("sum", F.col("new_epoch").cast("long"))})
    return df.withColumn("epoch", F.col("epoch").cast("long")).drop("__us", "__prev_us")


def clear_sessions(messages: DataFrame, ids: DataFrame, session_col: str = "session_id") -> DataFrame:
    """Delete whole histories (idempotent anti-join)."""
    return messages.join(ids.select(F.col(ids.columns[0]).alias(session_col)).distinct(), session_col, "left_anti")


# ----------------------------------------------------------------- J5 - J9
def session_cap(messages: DataFrame, cap: int, session_col: str = "session_id",
                turn_col: str = "turn", bucket_size: int = 1024) -> DataFrame:
    """J5 (isolated form): a turn is refused when the session already holds
    ``cap`` or more messages.  The prior count is a two-level scan over
    turn buckets, so one very long session is spread over tasks."""
    bucket = F.floor(F.col(turn_col) / F.lit(bucket_size)).cast("long")
    df = running(messages, [session_col], [F.col(turn_col)], bucket,
                 {"prior_messages": ("count", F.lit(1))}, inclusive=False)
    return df.withColumn("prior_messages", F.col("prior_messages").cast("long")).withColumn(
        "capped", F.col("prior_messages") >= cap)


def transcript_line(role, text) -> Column:
    """Only customer and non-empty assistant text is rendered."""
    r, t = _c(role), _c(text)
    return (F.when(r == "user", F.concat(F.lit("Customer: "), F.coalesce(t, F.lit(""))))
            .when((r == "assistant") & (F.length(F.coalesce(t, F.lit(""))) > 0),
                  F.concat(F.lit("Assistant: "), t)))


def last_n(arr: Column, n: int) -> Column:
    """Python ``lst[-n:]`` (Spark's negative ``slice`` returns [] when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n) + 1, F.lit(1)), F.lit(n))


def render_transcript(messages: DataFrame, max_lines: int = 6, session_col: str = "session_id",
                      turn_col: str = "turn") -> DataFrame:
    """The last ``max_lines`` rendered lines per session joined by a
    newline.  Lines are cut with ``row_number`` before collecting."""
    lines = messages.withColumn("__line", transcript_line("role", "text")).filter(F.col("__line").isNotNull())
    w = _session_window(session_col, turn_col, desc=True)
    lines = lines.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_lines)
    return lines.groupBy(session_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn_col, "__line"))), lambda x: x["__line"]),
                     "\n").alias("transcript"))


TRANSCRIPT_HEAD, MESSAGE_HEAD = "[earlier lines]", "[new message]"


def condenser_input(messages: DataFrame, max_lines: int = 6, session_col: str = "session_id",
                    turn_col: str = "turn", msg_col: str = "text", rewritten: str | None = None,
                    bucket_size: int = 1024, heads: tuple[str, str] = (TRANSCRIPT_HEAD, MESSAGE_HEAD)) -> DataFrame:
    """Per user message, the transcript of the rendered lines before it
    (at most ``max_lines``); first turns and empty transcripts pass the
    message unchanged, others get the condenser prompt.  A ``rewritten``
    column (model output joined in) replaces the message when non-blank,
    else the raw message is used (fail open).

    The look-back is split so a long session is not one task: a bounded
    window inside (session, turn bucket), plus the last ``max_lines`` lines
    of earlier buckets from a window over one row per bucket."""
    lines = (messages.withColumn("__line", transcript_line("role", msg_col)).filter(F.col("__line").isNotNull())
             .withColumn("__b", F.floor(F.col(turn_col) / F.lit(bucket_size)).cast("long")))
    w_in = Window.partitionBy(session_col, "__b").orderBy(turn_col).rowsBetween(-max_lines, -1)
    lines = lines.withColumn("__prev_in", F.collect_list("__line").over(w_in))
    # last max_lines lines of each bucket (row_number trim before collecting)
    tail = (lines.withColumn("__rn", F.row_number().over(
        Window.partitionBy(session_col, "__b").orderBy(F.col(turn_col).desc())))
        .filter(F.col("__rn") <= max_lines)
        .groupBy(session_col, "__b")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(turn_col, "__line"))), lambda x: x["__line"])
             .alias("__tail")))
    w_b = Window.partitionBy(session_col).orderBy("__b").rowsBetween(-max_lines, -1)
    carry = tail.select(session_col, "__b", last_n(F.flatten(F.coalesce(
        F.collect_list("__tail").over(w_b), F.array().cast("array<array<string>>"))), max_lines).alias("__carry"))
    t = join_same(lines.filter(F.col("role") == "user"), carry, [session_col, "__b"])
    prev = last_n(F.concat(F.col("__carry"), F.col("__prev_in")), max_lines)
    t = t.withColumn("__prev", prev)
    transcript = F.array_join("__prev", "\n")
    needs = F.size("__prev") > 0
    prompt = F.concat(F.lit(heads[0] + "\n"), transcript, F.lit("\n\n" + heads[1] + "\n"), F.col(msg_col))
    out = t.withColumns({"needs_rewrite": needs, "condenser_prompt": F.when(needs, prompt)})
    q = F.col(msg_col)
    if rewritten:
        q = F.when(needs & ~is_blank(rewritten), ustrip(rewritten)).otherwise(q)
    return out.withColumn("gate_query", q).drop("__line", "__prev", "__prev_in", "__carry", "__b")


def force_escalation(needs_human: Column, mentions: Column) -> Column:
    """Additive only."""
    return F.coalesce(needs_human, F.lit(False)) | F.coalesce(mentions, F.lit(False))


# ---------------------------------------------------------------- J10 - J18
def repeated_miss_escalation(turns: DataFrame, n: int = 2, session_col: str = "session_id",
                             order_col: str = "turn", miss_col: str = "miss", bucket=None) -> DataFrame:
    """A turn that is the n-th (or later) consecutive miss of its
    session forces escalation.  Run length = position - position of the last
    hit, both two-level scans over ``bucket`` (default: the order column in
    buckets of 1024 when it is numeric)."""
    order = [F.col(order_col)] if isinstance(order_col, str) else list(order_col)
    if bucket is None:
        bucket = F.floor(order[0] / F.lit(1024)).cast("long")
    df = running(turns, [session_col], order, bucket, {"__pos": ("count", F.lit(1))})
    df = running(df, [session_col], order, bucket,
                 {"__last_hit": ("max", F.when(~F.col(miss_col), F.col("__pos")))})
    run = F.col("__pos") - F.coalesce(F.col("__last_hit"), F.lit(0))
    return (df.withColumn("miss_run", F.when(F.col(miss_col), run).otherwise(F.lit(0)).cast("long"))
            .withColumn("force_escalation", F.col("miss_run") >= n).drop("__pos", "__last_hit"))


def topic_escalation(turn_chunks: DataFrame, topics: DataFrame, topic_col: str = "filename",
                     turn_col: str = "turn_id") -> DataFrame:
    """Turns whose retrieved chunks carry an escalation topic
    (``topics`` is a one-column frame: any size, semi-join)."""
    t = topics.select(F.col(topics.columns[0]).alias(topic_col)).distinct()
    return turn_chunks.join(t, topic_col, "left_semi").select(turn_col).distinct()


def handoff_outcome(no_context: Column, refuse_when_no_context: bool, enough_context: Column,
                    needs_human: Column) -> tuple[Column, Column]:
    """(outcome, model_called) from the four flags."""
    oos = F.coalesce(no_context, F.lit(False)) & F.lit(refuse_when_no_context)
    outcome = (F.when(oos, F.lit("out_of_scope")).when(~enough_context, F.lit("soft_offramp"))
               .when(needs_human, F.lit("handoff")).otherwise(F.lit("answer")))
    return outcome, ~oos


def escalation_signals(routed: DataFrame) -> DataFrame:
    """The routed turns that need a person, one row each: ``turn_id,
    session_id, turn, reason``. ``routed`` also carries ``ans_human``, whether
    the model itself asked for one."""
    reason = (F.when(F.col("capped"), F.lit("session_cap"))
              .when(F.col("agent_outcome") != "ok", F.concat(F.lit("agent:"), F.col("agent_outcome")))
              .when(F.col("ans_human"), F.lit("model")).otherwise(F.lit("keyword")))
    return routed.filter("needs_human").select("turn_id", "session_id", "turn", reason.alias("reason"))


def trim_history_tokens(messages: DataFrame, budget: int, session_col: str = "session_id",
                        turn_col: str = "turn", tokens_col: str = "tokens", bucket_size: int = 1024,
                        counter: Counter = None) -> DataFrame:
    """Keep the most recent messages whose running token sum (newest
    first) stays within the budget.  The running sum is a two-level scan
    over turn buckets (newest bucket first).  A message without a count in
    ``tokens_col``, or all if there is no such column, is counted by ``counter``."""
    counted = token_count("text", counter)
    df = messages.withColumn("__tok", F.coalesce(F.col(tokens_col), counted) if tokens_col in messages.columns else counted)
    bucket = -F.floor(F.col(turn_col) / F.lit(bucket_size)).cast("long")
    df = running(df, [session_col], [F.col(turn_col).desc()], bucket, {"running_tokens": ("sum", F.col("__tok"))})
    return df.filter(F.col("running_tokens") <= budget).drop("__tok")


# Refusal prefixes, checked in this order.
REFUSAL_PREFIXES = ("input_guard:jailbreak", "input_guard:pii", "input_guard:length", "input_guard",
                    "relevance_gate", "conversation_guard", "agent:")


def refusal_label(reason) -> Column:
    """Label of a refusal reason (null when not refused): the stage of the
    first known prefix and, where the prefix names one, its category, as
    ``stage / category``; an unknown reason is its own label."""
    r = _c(reason)
    out = F.when(r.isNull() | (r == ""), F.lit(None).cast("string"))
    for prefix in REFUSAL_PREFIXES:
        stage, _, category = prefix.partition(":")
        out = out.when(r.startswith(prefix), F.lit(f"{stage} / {category}" if category else stage))
    return out.otherwise(r)


def session_fold(turns: DataFrame, policy: Policy = DEFAULT_POLICY, session_col: str = "session_id",
                 turn_col: str = "turn", ts_col: str = "ts", input_ok: str = "input_ok",
                 eligible: str = "eligible") -> DataFrame:
    """Session cap with TTL when refused turns are not persisted (J5 inside
    J13).  Adds ``capped``.

    Only successful turns write (``messages_per_turn`` messages, trimmed to
    ``history_cap``) and refresh the TTL; a turn with input allowed is
    capped when the stored count is at least ``max_turns_per_session``.

    A cap needs ``c = ceil(cap / messages_per_turn)`` writes without a pause of
    the TTL between two of them. So for every write that could be a session's
    first since a reset, the write that fills it is ``c - 1`` places on, and the
    next first write is the earliest one a TTL after that: a pointer per write,
    found by equi-joins and two-level scans. The first writes that do occur are
    the orbit of the first one after each pause (``functions.orbit``), and a turn
    is capped if the last filling write before it is less than a TTL old. All
    steps are split by hour or block, so a session may hold any number of turns.
    A turn without a time is never capped and writes nothing.

    ``turns`` is materialised, as it is read three times.
    """
    ttl = policy.session_ttl_seconds * 1_000_000
    # a history cap below the session cap lets the store never fill
    fills = policy.history_cap >= policy.max_turns_per_session
    if policy.max_turns_per_session <= 0:
        return turns.withColumn("capped", F.col(input_ok))
    if not fills or policy.messages_per_turn <= 0:
        return turns.withColumn("capped", F.lit(False))
    c = -(-policy.max_turns_per_session // policy.messages_per_turn)
    key, bucket = [session_col], hour_bucket(ts_col)
    df = materialized(turns.withColumn("__row", F.monotonically_increasing_id()), "fold-turns")
    slim = df.select(*key, ts_col, turn_col, "__row", F.unix_micros(F.col(ts_col).cast("timestamp")).alias("__t"),
                     F.coalesce(F.col(input_ok), F.lit(False)).alias("__ok"), F.col(eligible).alias("__el"))
    slim = slim.withColumn("__ok", F.col("__ok") & F.col("__t").isNotNull())
    slim = slim.withColumn("__el", F.col("__ok") & F.coalesce(F.col("__el"), F.lit(False)))
    slim = running(slim, key, [F.col(ts_col), F.col(turn_col), F.col("__row")], bucket,
                   {"__rk": ("count", F.lit(1)), "__n": ("sum", F.col("__el").cast("long"))})
    slim = materialized(slim.withColumn("__w", F.col("__n") - 1).drop("__n"), "fold-places")

    # writes of sessions that can fill at all, cut at pauses of the TTL
    writes = slim.filter("__el").select(*key, "__w", "__t", "__rk")
    able = writes.filter(F.col("__w") == c - 1).select(*key)  # one row per session
    writes = join_same(writes, able, key, "left_semi")
    by_time = F.floor(F.col("__t") / F.lit(3_600_000_000)).cast("long")
    writes = previous(writes, key, [F.col("__w")], by_time, "__t", "__prev")
    pause = F.col("__prev").isNull() | (F.col("__t") - F.col("__prev") >= ttl)
    writes = running(writes, key, [F.col("__w")], by_time, {"__seg": ("max", F.when(pause, F.col("__w")))})
    writes = materialized(writes.drop("__prev"), "fold-writes")
    full = writes.select(*key, (F.col("__w") - (c - 1)).alias("__w"), F.col("__seg").alias("__fseg"),
                         F.col("__t").alias("__ft"), F.col("__rk").alias("__frk"))
    starts = join_same(writes.select(*key, "__seg", "__w"), full, [*key, "__w"]).filter("__fseg = __seg").drop("__fseg")
    # of the writes in time order, the first that is not before the filling write's time + TTL
    probes = starts.select(*key, "__w", (F.col("__ft") + ttl).alias("__t"), F.lit(0).alias("__kind"))
    both = probes.unionByName(writes.select(*key, "__w", "__t", F.lit(1).alias("__kind")))
    both = running(both, key, [F.col("__t"), F.col("__kind"), F.col("__w")], by_time, {"__to": ("sum", F.col("__kind"))})
    nxt = both.filter("__kind = 0").select(*key, "__w", F.col("__to").alias("__next"))
    links = join_same(writes.select(*key, "__seg", "__w"), nxt, [*key, "__w"], "left")
    links = materialized(links.select(*key, "__seg", (F.col("__w") - F.col("__seg")).alias("idx"),
                                      (F.col("__next") - F.col("__seg")).alias("next")), "fold-links")
    first = orbit(links, [*key, "__seg"]).select(*key, (F.col("__seg") + F.col("idx")).alias("__w"))
    fill = join_same(starts, first, [*key, "__w"]).select(*key, F.col("__frk").alias("__rk"), F.col("__ft").alias("__fill"))

    marked = join_same(slim, fill, [*key, "__rk"], "left")
    marked = running(marked, key, [F.col("__rk")], bucket, {"__last": ("max", F.col("__fill"))}, inclusive=False)
    capped = F.col("__ok") & F.coalesce(F.col("__t") - F.col("__last") < ttl, F.lit(False))
    return df.join(marked.select("__row", capped.alias("capped")), "__row").drop("__row")

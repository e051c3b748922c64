"""Registered streaming queries (K1-K8).

The input table lands in a folder in several arrivals; after each, a stream over
the folder runs with ``trigger(availableNow=True)`` from the same checkpoint, as
a scheduled job would, and appends to a Parquet sink, which the query returns as
a batch frame. Event-time inputs arrive out of order by up to the watermark
delay. Streams that wait for the watermark get one control row in the year 2100
as a last arrival, so that nothing is left waiting; results of that time are cut.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, functions as F

from railyard.functions.text import ts_text
from railyard.plans.ingest import ingest_documents
from railyard.plans.registry import register
from railyard.operators.chunking import line_blocks
from railyard.policy import DEFAULT_POLICY
from railyard.session import scratch_path
from railyard.sources.chunk_store import apply_batch, compact_chunks, create_store, current_chunks, stream_upsert
from railyard.sources.chunk_table import classify_files
from railyard.sources.tables import table
from railyard.streaming import streams as K

CONTROL_TS = "2100-01-01 00:00:00"
CONTROL_US = 4102444800000000
ARRIVALS = 3


def by_hash(*cols: str) -> Column:
    """Arrival of a row whose order does not matter."""
    return F.pmod(F.xxhash64(*cols), F.lit(ARRIVALS))


def by_time(df, ts_col: str, disorder_seconds: int) -> Column:
    """Arrival by event time, each row up to ``disorder_seconds`` late; rows
    without a time come first."""
    late = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, disorder_seconds * 1_000_000)))
    at = F.unix_micros(F.col(ts_col).cast("timestamp")) + late
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return F.lit(0)
    return F.coalesce(F.floor((at - lo) * ARRIVALS / (hi - lo + 1)), F.lit(0)).cast("int")


def arriving(df, name: str, arrival: Column, run, control=None) -> str:
    """Lets ``df`` arrive in a fresh folder and calls ``run(stream, base)`` after
    each arrival; the folder's parent. ``control`` rows arrive last."""
    spark = df.sparkSession
    base = scratch_path(spark, name)
    path = os.path.join(base, "in")
    parts = [df.filter(arrival == k) for k in range(ARRIVALS)] + ([control] if control is not None else [])
    for part in parts:
        part.write.mode("append").parquet(path)
        run(K.file_stream(spark, path, df.schema), base)
    return base


def drained(df, name: str, arrival: Column, build, control=None):
    """The sink of ``build(stream)`` after all arrivals."""
    out = {}

    def run(stream, base):
        built = build(stream)
        out["schema"] = built.schema
        K.run_available_now(built, os.path.join(base, "out"), os.path.join(base, "ckpt"))

    base = arriving(df, name, arrival, run, control)
    return df.sparkSession.read.schema(out["schema"]).parquet(os.path.join(base, "out"))


def control_row(df, ts_col: str = "ts"):
    """One row of nulls at CONTROL_TS."""
    spark = df.sparkSession
    return spark.range(1).select(*[
        (F.lit(CONTROL_TS).cast(f.dataType) if f.name == ts_col else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in df.schema.fields])


def drained_in_time(df, name: str, build, disorder_seconds: int, ts_col: str = "ts"):
    return drained(df, name, by_time(df, ts_col, disorder_seconds), build, control_row(df, ts_col))


#: Rows of a key group of the event-time streams over the whole input, on average.
GROUP_ROWS = 4096


def key_groups(df) -> int:
    """Groups to deal the keys of ``df`` to: their size does not grow with the input."""
    return max(16, -(-df.count() // GROUP_ROWS))


@register("stream_guard_turns")
def q_stream_guard_turns(spark, sf):
    """K1: input guards + handoff keyword on a message stream; equals the
    batch guards on user messages (oracle: evaluate_input_turns)."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    out = drained(c, "k1", by_hash("conv_id", "turn"), lambda s: K.stream_guard_turns(s, DEFAULT_POLICY, "text"))
    return out.select("conv_id", "turn", "input_allowed", "input_category", "input_reason", "input_flagged")


@register("stream_sessions", sql="""
WITH g AS (SELECT user_id, event_id, ts,
                  epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
e AS (SELECT *, sum(CASE WHEN gap >= 3600000000 THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ep
      FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 3599999999 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       count(*) AS n_events
FROM e GROUP BY user_id, ep""")
def q_stream_sessions(spark, sf):
    """K2: 1 h idle-timeout sessions from the event stream (equals J3 epochs)."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id")
    out = drained_in_time(ev, "k2", lambda s: K.stream_sessions(s, 3600), 3599)
    out = out.filter(F.unix_micros("session.start") < CONTROL_US)
    return out.select("user_id", ts_text(F.col("session.start").cast("timestamp_ntz")).alias("session_start"),
                      ts_text(F.col("session.end").cast("timestamp_ntz")).alias("session_end"), "n_events")


_K3P = DEFAULT_POLICY.with_(session_ttl_seconds=86400, max_turns_per_session=5, messages_per_turn=1)


_K3P = DEFAULT_POLICY.with_(session_ttl_seconds=86400, max_turns_per_session=5, messages_per_turn=1)
#: A cap that is never reached: the kept messages alone.
_K3KEEP = DEFAULT_POLICY.with_(session_ttl_seconds=21600, max_turns_per_session=1_000, messages_per_turn=1, max_history_turns=1)


@register("stream_history_state", sql=f"""
WITH RECURSIVE r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk
                     FROM events),
walk AS (
  SELECT user_id, rk, event_id, FALSE AS capped, ts AS last_ts, [event_id] AS kept FROM r WHERE rk = 1
  UNION ALL
  SELECT r.user_id, r.rk, r.event_id, len(s.k0) >= {_K3P.max_turns_per_session},
         CASE WHEN len(s.k0) < {_K3P.max_turns_per_session} THEN r.ts ELSE w.last_ts END,
         CASE WHEN len(s.k0) < {_K3P.max_turns_per_session}
              THEN list_append(s.k0, r.event_id)[-{_K3P.history_cap}:] ELSE s.k0 END
  FROM walk w JOIN r ON r.user_id IS NOT DISTINCT FROM w.user_id AND r.rk = w.rk + 1,
       LATERAL (SELECT CASE WHEN len(w.kept) > 0 AND epoch_us(r.ts) - epoch_us(w.last_ts) >= {86400 * 1000000}
                            THEN [] ELSE w.kept END AS k0) s)
SELECT user_id, event_id, capped, array_to_string(kept, ',') AS kept FROM walk""")
def q_stream_history_state(spark, sf):
    """K3: stored messages per user with TTL 24 h refreshed on write and a cap of
    5 messages: the ids kept after each event and whether it was capped."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id")
    K.use_rocksdb(spark)
    groups = key_groups(ev)
    out = drained_in_time(ev, "k3", lambda s: K.stream_history_state(s, _K3P, "user_id", "event_id", "ts", groups=groups), 3599)
    return out.filter(F.col("t") < CONTROL_US).select(
        F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.col("flag").alias("capped"),
        F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@register("stream_history_kept", sql=f"""
WITH g AS (SELECT user_id, event_id, ts,
                  epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
e AS (SELECT *, sum(CASE WHEN gap >= {_K3KEEP.session_ttl_seconds * 1000000} THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ep FROM g)
SELECT user_id, event_id, string_agg(CAST(event_id AS VARCHAR), ',') OVER (
         PARTITION BY user_id, ep ORDER BY ts, event_id ROWS BETWEEN {_K3KEEP.history_cap - 1} PRECEDING AND CURRENT ROW)
         AS kept FROM e""")
def q_stream_history_kept(spark, sf):
    """K3: the newest 4 messages of the session (J2) within epochs of 6 h."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id")
    K.use_rocksdb(spark)
    groups = key_groups(ev)
    out = drained_in_time(ev, "k3k", lambda s: K.stream_history_state(s, _K3KEEP, "user_id", "event_id", "ts", groups=groups), 3599)
    return out.filter(F.col("t") < CONTROL_US).select(
        F.col("key").alias("user_id"), F.col("id").alias("event_id"),
        F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@register("stream_rate_limit", sql="""
SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS n,
       count(*) > 1 AS over_limit
FROM events GROUP BY user_id, date_trunc('minute', ts)""")
def q_stream_rate_limit(spark, sf):
    """K4: messages per user and minute, limit 1 (tumbling windows)."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id")
    out = drained_in_time(ev, "k4", lambda s: K.stream_rate_limit(s, 1), 59)
    out = out.filter(F.unix_micros("w.start") < CONTROL_US)
    return out.select("user_id", ts_text(F.col("w.start").cast("timestamp_ntz")).alias("window_start"), "n",
                      "over_limit")


@register("rate_limit_exact", sql="""
SELECT event_id, user_id, count(*) OVER w AS n_last_minute, count(*) OVER w > 1 AS over_limit FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""")
def q_rate_limit_exact(spark, sf):
    """K4, exact: messages of the user in the minute up to each one."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return K.rate_limit_exact(ev, 1).select("event_id", "user_id", "n_last_minute", "over_limit")


def _files_and_chunks(batch):
    """A micro-batch of documents: all its files, and the chunks of those accepted."""
    files = classify_files(doc_files_from(batch), "path").withColumn("file_path", F.col("path"))
    return files.select("doc_id"), ingest_documents(line_blocks(batch), files)


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    """K5 with A4: documents land in three arrivals, a third of them first as a
    longer draft; the drafts' final texts follow, so those files shrink. The
    store is merged once, and the last batch is applied twice. The table equals
    batch ingest (oracle: ingest_documents)."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    draft = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    first = d.withColumn("text", F.when(draft, F.concat("text", F.lit("\n"), "text", F.lit("\ndraft"))).otherwise(F.col("text")))
    base = scratch_path(spark, "k5")
    inbox, store, ckpt = (os.path.join(base, x) for x in ("in", "store", "ckpt"))
    create_store(spark, store, _files_and_chunks(d.limit(0))[1].schema)
    final = d.filter(draft)
    for k, part in enumerate([*[first.filter(by_hash("doc_id") == i) for i in range(ARRIVALS)], final]):
        part.write.mode("append").parquet(inbox)
        stream_upsert(K.file_stream(spark, inbox, d.schema), store, ckpt, _files_and_chunks)
        if k == 1:
            compact_chunks(spark, store)
    apply_batch(store, ARRIVALS, *_files_and_chunks(final))
    return current_chunks(spark, store).select(
        "id", "filename", "file_type", "chunk_index", "raw_token_count", "contextualized_token_count",
        F.md5("contents").alias("contents_md5"))


def doc_files_from(d):
    from railyard.plans.q_tables import _EXT
    ext = F.coalesce(F.element_at(F.create_map(*[x for k, v in _EXT.items() for x in (F.lit(k), F.lit(v))]),
                                  F.col("lang")), F.lit(""))
    return d.select("doc_id", F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"),
                                       F.col("doc_id").cast("string"), ext).alias("path"))


@register("stream_embedding_dedup")
def q_stream_embedding_dedup(spark, sf):
    """K6: embed a key at most once per 24 h (exact keyed state); equals
    D6 (oracle: embedding_cache_replay)."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id")
    K.use_rocksdb(spark)
    groups = key_groups(ev)
    out = drained_in_time(ev, "k6", lambda s: K.stream_embedding_dedup(s, 86400, "user_id", "event_id", "ts", groups=groups), 3599)
    return out.filter(F.col("t") < CONTROL_US).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"),
                      ts_text(F.timestamp_micros("t").cast("timestamp_ntz")).alias("ts"), F.col("flag").alias("cache_hit"))


@register("stream_outcome_windows", sql="""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*) AS n
FROM events GROUP BY 1, 2""")
def q_stream_outcome_windows(spark, sf):
    """K7: outcomes (event types) per day window with a watermark."""
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type")
    out = drained_in_time(ev, "k7", lambda s: K.stream_outcome_windows(s, "event_type"), 3599)
    out = out.filter(F.unix_micros("w.start") < CONTROL_US)
    return out.select(ts_text(F.col("w.start").cast("timestamp_ntz")).alias("window_start"), "event_type", "n")


@register("stream_late_rows", sql="""
WITH n AS (SELECT count(*) AS n_events,
                  count(*) FILTER (ts < (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL 1 DAY) AS n_late FROM events)
SELECT n_events + n_late AS n_arrived, n_events AS n_in_windows, n_late, n_late > 0 AS dropped FROM n""")
def q_stream_late_rows(spark, sf):
    """K7: the first day's events arrive once more at the end, long past the
    watermark. The report counts them; the day windows do not."""
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type")
    first = F.date_trunc("day", F.lit(ev.agg(F.min("ts")).first()[0])) + F.expr("INTERVAL 1 DAY")
    progress, base = [], None

    def run(stream, folder):
        built = K.stream_outcome_windows(K.watched(stream), "event_type")
        progress.extend(K.run_available_now(built, os.path.join(folder, "out"), os.path.join(folder, "ckpt")))

    base = arriving(ev, "k7late", by_time(ev, "ts", 3599), run, ev.filter(F.col("ts") < first))
    path = os.path.join(base, "in")
    control_row(ev).write.mode("append").parquet(path)
    run(K.file_stream(spark, path, ev.schema), base)
    counted = (spark.read.parquet(os.path.join(base, "out")).filter(F.unix_micros("w.start") < CONTROL_US)
               .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_in_windows")))
    report = K.late_row_report(spark, progress).agg((F.sum("n_arrived") - 1).alias("n_arrived"),  # the control row
                                                    (F.sum("n_dropped") > 0).alias("dropped"))
    return report.join(F.broadcast(counted)).select(  # one row each
        "n_arrived", "n_in_windows", (F.col("n_arrived") - F.col("n_in_windows")).alias("n_late"), "dropped")


@register("stream_misses")
def q_stream_misses(spark, sf):
    """K8: consecutive error events per user with keyed state; equals J10
    (oracle: repeated_miss_escalation)."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", (F.col("event_type") == "error").alias("miss"))
    K.use_rocksdb(spark)
    groups = key_groups(ev)
    out = drained_in_time(ev, "k8", lambda s: K.stream_misses(s, 2, "user_id", "event_id", "ts", "miss", groups=groups), 3599)
    return out.filter(F.col("t") < CONTROL_US).select(
        F.col("key").alias("user_id"), F.col("id").alias("event_id"), "miss",
        F.col("run").alias("miss_run"), F.col("flag").alias("force_escalation"))


def _twin(name, twin):
    """Streaming queries whose oracle is their batch twin's SQL."""
    from railyard.plans import registry
    registry._SQL[name] = registry._SQL[twin]


_twin("stream_guard_turns", "evaluate_input_turns")
_twin("stream_ingest", "ingest_documents")
_twin("stream_embedding_dedup", "embedding_cache_replay")
_twin("stream_misses", "repeated_miss_escalation")

"""Structured Streaming forms of the stateful rules (K1-K8).

* Stateless guards (K1) reuse the batch Column functions on ``readStream``.
* Time windows (K2, K4, K7) use ``withWatermark`` with ``session_window`` /
  ``window`` in append mode; rows later than the watermark are dropped and
  reported in ``numRowsDroppedByWatermark``.
* Sequential per-key rules (K3, K6, K8) use ``transformWithStateInPandas`` in
  event time (RocksDB state store), for groups of keys at a time. A row waits in
  its group's list state until the watermark has passed it; a timer then applies
  all rows that are due in (time, id) order, key by key. So rows may arrive in any
  order within the watermark delay, over any number of micro-batches, and the
  result is that of the batch rule. A key whose state can no longer matter leaves
  the store by timer.
* Ingest (K5) is ``foreachBatch`` into the chunk store of
  ``railyard.sources.chunk_store``: a replayed batch overwrites itself.

``events.ts`` is ``timestamp_ntz``; watermarks need ``timestamp``, so the
helpers cast it (session time zone UTC).
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter
from typing import Iterator, Optional

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from railyard.operators.input_guards import evaluate_input, mentions_human
from railyard.policy import DEFAULT_POLICY, Policy

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _pickle_processors_by_value() -> None:
    """The stateful-processor classes are unpickled by a driver-side Python
    runner that does not see ``addPyFile`` archives; ship them by value."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older cloudpickle: fall back to by-reference
        pass


def use_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: Optional[int] = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


def run_available_now(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> list:
    """Drain everything available into a parquet sink, then stop; the progress
    reports of its micro-batches."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return list(q.recentProgress)


def watched(events: DataFrame, name: str = "arrived") -> DataFrame:
    """``events`` with their number observed per micro-batch."""
    return events.observe(name, F.count(F.lit(1)).alias("n"))


def late_row_report(spark: SparkSession, progress: list, name: str = "arrived") -> DataFrame:
    """K7: one row per micro-batch: rows that arrived, the watermark in force and
    the rows (partial sums, where Spark sums before the shuffle) that came too
    late for it. ``progress`` is what :func:`run_available_now` returns."""
    rows = []
    for p in progress:
        seen = p.observedMetrics.get(name)
        rows.append((p.batchId, int(seen["n"]) if seen is not None else 0, p.eventTime.get("watermark"),
                     sum(s.numRowsDroppedByWatermark for s in p.stateOperators)))
    return spark.createDataFrame(rows, "batch long, n_arrived long, watermark string, n_dropped long")


# --------------------------------------------------------------------- K1
def stream_guard_turns(messages: DataFrame, policy: Policy = DEFAULT_POLICY, msg_col: str = "text") -> DataFrame:
    """K1: input guards and the handoff keyword on a message stream (stateless)."""
    return evaluate_input(messages, msg_col, policy).withColumn("mentions_human", mentions_human(msg_col))


# --------------------------------------------------------------------- K2, K4, K7
def _interval_minus_micro(seconds: int) -> str:
    us = seconds * 1_000_000 - 1
    return f"{us // 1_000_000} seconds {us % 1_000_000} microseconds"


def stream_sessions(events: DataFrame, ttl_seconds: int, key_col: str = "user_id", ts_col: str = "ts",
                    watermark: str = "1 hour") -> DataFrame:
    """K2: idle-timeout sessions.  ``session_window`` merges events closer
    than its gap, so a gap of TTL - 1 µs splits exactly at gaps >= TTL (the
    batch rule of J3)."""
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    sw = F.session_window(ts_col, _interval_minus_micro(ttl_seconds))
    return ev.groupBy(key_col, sw.alias("session")).agg(F.count("*").alias("n_events"))


def stream_rate_limit(events: DataFrame, limit: int, key_col: str = "user_id", ts_col: str = "ts",
                      watermark: str = "1 minute", slide: Optional[str] = None) -> DataFrame:
    """K4: messages per key and minute (tumbling, or sliding with ``slide``);
    ``over_limit`` marks windows above the limit."""
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    w = F.window(ts_col, "1 minute", slide) if slide else F.window(ts_col, "1 minute")
    return (ev.groupBy(key_col, w.alias("w")).agg(F.count("*").alias("n"))
            .withColumn("over_limit", F.col("n") > limit))


def rate_limit_exact(events: DataFrame, limit: int, key_col: str = "user_id", ts_col: str = "ts",
                     seconds: int = 60) -> DataFrame:
    """K4 batch form: messages of the key in the ``seconds`` up to and including
    each one. Every row goes to its own stretch of that length and, as a
    forerunner only, to the next, so a hot key is one window per stretch. Null
    keys are a key of their own; rows without a time count nothing."""
    width = seconds * 1_000_000
    df = events.withColumn("__t", F.unix_micros(F.col(ts_col).cast("timestamp")))
    df = df.withColumn("__at", F.floor(F.col("__t") / F.lit(width)).cast("long"))
    df = df.withColumn("__own", F.explode(F.when(F.col("__t").isNull(), F.array(F.lit(True)))
                                          .otherwise(F.array(F.lit(True), F.lit(False)))))
    df = df.withColumn("__at", F.when(F.col("__own"), F.col("__at")).otherwise(F.col("__at") + 1))
    w = Window.partitionBy(key_col, "__at").orderBy("__t").rangeBetween(-width + 1, 0)
    n = F.when(F.col("__t").isNull(), F.lit(0)).otherwise(F.count("*").over(w))
    return (df.withColumn("n_last_minute", n).filter("__own").drop("__t", "__at", "__own")
            .withColumn("over_limit", F.col("n_last_minute") > limit))


def stream_outcome_windows(events: DataFrame, outcome_col: str, ts_col: str = "ts", window: str = "1 day",
                           watermark: str = "1 hour") -> DataFrame:
    """K7: outcomes per time window."""
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    return ev.groupBy(F.window(ts_col, window).alias("w"), outcome_col).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- K3, K6, K8
_PENDING = "gk array<string>, t array<long>, has_id array<boolean>, id array<long>, flag array<boolean>"
_OUT = "gk string, t long, has_id boolean, id long, flag boolean"
_ROW = ("gk", "t", "has_id", "id", "flag")
#: Groups that the keys are dealt to by hash; fixed for the life of a checkpoint.
KEY_GROUPS = 1024


def _held(state) -> dict:
    """What a list state kept by column holds of each key."""
    return {r[0]: r[1:] for cols in state.get() for r in zip(*cols)} if state.exists() else {}


def _hold(state, rows: dict) -> None:
    if rows:
        state.put([tuple(map(list, zip(*((gk, *r) for gk, r in rows.items()))))])
    else:
        state.clear()


class OrderedProcessor(StatefulProcessor):
    """Applies ``run`` to each key's rows in (t, id) order, rows without an id first.

    Every call on the state is a round trip to the JVM, so keys are dealt to groups
    and a group's keys share the calls: ``pending`` holds the rows that the watermark
    has not passed yet, ``state`` what each key has (both by column, as an element is
    a message of its own), ``due`` the time of the group's next timer. Input at or before
    the watermark is dropped by Spark before it gets here, so rows that are due can
    have no forerunner left.
    """

    state_schema = "v array<long>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.due = handle.getValueState("due", "ms long")
        self.state = handle.getListState("state", "gk array<string>, " + self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, first = [], None
        for pdf in rows:
            cols = [pdf[c].tolist() for c in _ROW]
            new.append(tuple(cols))
            least = min(cols[1])
            first = least if first is None else min(first, least)
        if new:
            self.pending.appendList(new)
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        waiting = [r for cols in self.pending.get() for r in zip(*cols)] if self.pending.exists() else []
        ready = sorted(r for r in waiting if r[1] <= now)
        rest = [r for r in waiting if r[1] > now]
        old = self.load()
        states = dict(old)
        if ready:
            if rest:
                self.pending.put([tuple(map(list, zip(*rest)))])
            else:
                self.pending.clear()
            more: dict = {}
            for gk, own in groupby(ready, key=itemgetter(0)):
                made, states[gk] = self.run([r[1:] for r in own], states.get(gk))
                for name, values in made.items():
                    more.setdefault(name, []).extend(values)
            yield pd.DataFrame({**dict(zip(_ROW, map(list, zip(*ready)))), **more})
        # rows still waiting are later than the end of a state that ends now
        ends = {gk: self.ends(s) for gk, s in states.items() if s is not None}
        states = {gk: states[gk] for gk, end in ends.items() if end is None or end > now}
        if states != old:
            self.save(states)
        times = [r[1] for r in rest] + [end for gk, end in ends.items() if gk in states and end is not None]
        if times:
            self._wake(min(times), now // 1000)

    def _wake(self, at_us: int, watermark_ms: int) -> None:
        """A timer at the first millisecond that is not before ``at_us`` and that the
        watermark has yet to pass, as a timer in the past need not fire."""
        ms = max(-(-at_us // 1000), watermark_ms + 1)
        if not self.due.exists() or ms < self.due.get()[0]:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def run(self, ready: list, state: Optional[tuple]) -> tuple[dict, Optional[tuple]]:
        """Output columns of a key's rows (t, has_id, id, flag), in order, and the
        key's state after them; None is no state."""
        raise NotImplementedError

    def load(self) -> dict:
        """State of the group's keys that have one."""
        return _held(self.state)

    def save(self, states: dict) -> None:
        _hold(self.state, states)

    def ends(self, state: tuple) -> Optional[int]:
        """Microsecond from which on a key's state no longer matters; None if it has no such time."""
        return None

    def close(self) -> None:
        pass


class HistoryProcessor(OrderedProcessor):
    """K3: the messages that a session keeps. A write appends the turn's messages
    and trims to the newest ``trim``; a session idle for the TTL since its last
    write is empty; a turn is capped, and writes nothing, when ``cap`` messages
    are stored. An idle session's state goes by timer at last write + TTL."""

    state_schema = "last array<long>"

    def __init__(self, ttl_us: int, cap: int, per_turn: int, trim: int):
        self.ttl_us, self.cap, self.per_turn, self.trim = ttl_us, cap, per_turn, trim

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stored = handle.getListState("stored", "gk array<string>, has_id array<array<boolean>>, id array<array<long>>")

    def load(self):
        stored = _held(self.stored)
        return {gk: (last, *stored[gk]) for gk, (last,) in super().load().items()}

    def save(self, states):
        super().save({gk: s[:1] for gk, s in states.items()})
        _hold(self.stored, {gk: s[1:] for gk, s in states.items()})

    def run(self, ready, state):
        last, kept = (state[0], list(zip(state[1], state[2]))) if state else (None, [])
        capped, lists = [], []
        for t, has_id, id_, _ in ready:
            if kept and t - last >= self.ttl_us:
                kept = []
            capped.append(len(kept) >= self.cap)
            if not capped[-1]:
                kept = (kept + [(has_id, id_)] * self.per_turn)[-self.trim:]
                last = t
            lists.append([i if h else None for h, i in kept])
        state = None if last is None else (last, [h for h, _ in kept], [i for _, i in kept])
        return {"flag": capped, "kept": lists}, state

    def ends(self, state):
        return state[0] + self.ttl_us


class CacheReplayProcessor(OrderedProcessor):
    """K6 (exact): a miss sets expiry = t + TTL, a hit never extends it."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def run(self, ready, state):
        expiry = state[0] if state else -(2 ** 62)
        hits = []
        for t, *_ in ready:
            hits.append(t < expiry)
            if not hits[-1]:
                expiry = t + self.ttl_us
        return {"flag": hits}, (expiry,)

    def ends(self, state):
        return state[0]


class MissRunProcessor(OrderedProcessor):
    """K8: consecutive misses, reset by a hit. A key without an open run has no
    state; with ``forget_us`` an open run ends that long after its last miss."""

    state_schema = "run array<long>, last array<long>"

    def __init__(self, n: int, forget_us: Optional[int] = None):
        self.n, self.forget_us = n, forget_us

    def run(self, ready, state):
        run, last = state or (0, 0)
        runs = []
        for t, _, _, miss in ready:
            if self.forget_us is not None and run and t - last >= self.forget_us:
                run = 0
            run, last = (run + 1 if miss else 0), t
            runs.append(run)
        cols = {"flag": [r >= self.n for r in runs], "run": runs, "miss": [r[3] for r in ready]}
        return cols, ((run, last) if run else None)

    def ends(self, state):
        return None if self.forget_us is None else state[1] + self.forget_us


def _ordered(events: DataFrame, processor: OrderedProcessor, more: str, key_col: str, id_col: str, ts_col: str,
             watermark: str, flag: Optional[str] = None, groups: int = KEY_GROUPS) -> DataFrame:
    """key, id, t (microseconds), flag and further columns of ``processor``.
    A null key is a key of its own; rows without a time cannot be placed and are
    left out, as event-time windows leave them out. Keys are dealt to ``groups``."""
    key_type = dict(events.dtypes)[key_col]
    k = (events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).filter(F.col(ts_col).isNotNull())
         .withWatermark(ts_col, watermark)
         .select(F.when(F.col(key_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(key_col).cast("string"))).alias("gk"),
                 ts_col, F.unix_micros(ts_col).alias("t"), F.col(id_col).isNotNull().alias("has_id"),
                 F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id"),
                 (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)).alias("flag"))
         .withColumn("group", F.pmod(F.xxhash64("gk"), F.lit(groups)).cast("int")))
    out = k.groupBy("group").transformWithStateInPandas(processor, _OUT + more, "Append", "EventTime")
    rest = [c for c in out.columns if c not in ("gk", "t", "has_id", "id")]
    return out.select(F.when(F.col("gk") != "-", F.substring("gk", 2, 1 << 30)).cast(key_type).alias("key"),
                      F.when(F.col("has_id"), F.col("id")).alias("id"), "t", *rest)


def stream_history_state(events: DataFrame, policy: Policy, key_col: str, id_col: str, ts_col: str,
                         watermark: str = "1 hour", groups: int = KEY_GROUPS) -> DataFrame:
    """K3: key, id, t, flag (capped) and ``kept``: ids of the session's stored
    messages after the event. With every turn eligible this is the stream twin
    of ``session_fold``; with a cap above ``history_cap`` it is ``append_history``
    within the epochs of ``expire_sessions``."""
    proc = HistoryProcessor(policy.session_ttl_seconds * 1_000_000, policy.max_turns_per_session,
                            policy.messages_per_turn, policy.history_cap)
    return _ordered(events, proc, ", kept array<long>", key_col, id_col, ts_col, watermark, groups=groups)


def stream_embedding_dedup(requests: DataFrame, ttl_seconds: int, key_col: str, id_col: str,
                           ts_col: str, watermark: str = "1 hour", groups: int = KEY_GROUPS) -> DataFrame:
    """K6 (exact): hit/miss per request, stream twin of D6."""
    return _ordered(requests, CacheReplayProcessor(ttl_seconds * 1_000_000), "", key_col, id_col, ts_col, watermark,
                    groups=groups)


def stream_misses(turns: DataFrame, n: int, key_col: str, id_col: str, ts_col: str, miss_col: str,
                  watermark: str = "1 hour", forget_seconds: Optional[int] = None,
                  groups: int = KEY_GROUPS) -> DataFrame:
    """K8: forced escalation after n consecutive misses, stream twin of J10; a
    null ``miss_col`` counts as a hit."""
    forget = None if forget_seconds is None else forget_seconds * 1_000_000
    return _ordered(turns, MissRunProcessor(n, forget), ", run long, miss boolean", key_col, id_col, ts_col, watermark,
                    flag=miss_col, groups=groups)


# --------------------------------------------------------------------- K5
def latest_chunks(spark: SparkSession, sink: str, doc_col: str = "doc_id") -> DataFrame:
    """Read plain batch folders keeping, of each document, the chunks of the newest
    batch that holds it: a file that has shrunk leaves none of its old chunks.
    The chunk store also knows documents that have no chunk any more."""
    df = spark.read.parquet(sink)
    newest = df.groupBy(F.col(doc_col).alias("__doc")).agg(F.max("batch").alias("__newest"))
    cond = df[doc_col].eqNullSafe(newest["__doc"]) & (df["batch"] == newest["__newest"])
    return df.join(newest, cond, "left_semi").drop("batch")


_pickle_processors_by_value()

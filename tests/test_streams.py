"""Streams on rows that arrive late, without a key or without an id; state that
goes; the chunk store's replays and merges."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from railyard.plans import catalog
from railyard.policy import DEFAULT_POLICY
from railyard.sources import chunk_store as S
from railyard.streaming import streams as K

Q = catalog.q_streaming
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, props string"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Events with null and negative users, null types and null ids."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(None if i % 13 == 5 else i, T0 + dt.timedelta(minutes=7 * i), (None, -1, 0, 3)[i % 4],
             (None, "-1", "error")[i % 3], "{}") for i in range(240)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path + "/events.parquet")
    return path, rows


def _by_user(rows):
    out = {}
    for r in rows:
        out.setdefault(r[2], []).append(r)
    return out


def test_sessions_and_rates_keep_all_keys(spark, odd):
    path, rows = odd
    got = Q.q_stream_sessions(spark, path).collect()
    assert {u: sum(r.n_events for r in got if r.user_id == u) for u in (None, -1, 0, 3)} == {u: 60 for u in (None, -1, 0, 3)}
    got = Q.q_stream_rate_limit(spark, path).collect()
    assert sum(r.n for r in got) == len(rows) and {r.user_id for r in got} == {None, -1, 0, 3}
    got = Q.q_stream_outcome_windows(spark, path).collect()
    assert sum(r.n for r in got) == len(rows) and {r.event_type for r in got} == {None, "-1", "error"}


def test_history_keeps_all_keys(spark, odd):
    path, rows = odd
    got = {(r.user_id, r.event_id, r.kept) for r in Q.q_stream_history_kept(spark, path).collect()}
    want = set()
    for user, seq in _by_user(rows).items():
        kept, last = [], None
        for eid, ts, *_ in seq:
            if last is not None and (ts - last).total_seconds() >= Q._K3KEEP.session_ttl_seconds:
                kept = []
            kept, last = (kept + [eid])[-Q._K3KEEP.history_cap:], ts
            want.add((user, eid, ",".join(str(i) for i in kept if i is not None)))
    assert got == want


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, miss boolean")


def _land(df, base, name):
    df.coalesce(1).write.mode("append").parquet(os.path.join(base, name))


@pytest.fixture(scope="module")
def shuffled():
    """Five files of events, out of order by up to 50 minutes, and their rows by user."""
    rng = random.Random(4)
    rows = [(i, T0 + dt.timedelta(minutes=i // 2, seconds=rng.randrange(60)), rng.choice((1, 2, None)), rng.random() < 0.6)
            for i in range(400)]
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(50)))
    rng.shuffle(arrival[:40])
    by_user = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by_user.setdefault(r[2], []).append(r)
    return [arrival[i * 80:(i + 1) * 80] for i in range(5)], by_user


def _drain(spark, files, base, build):
    progress = []
    control = [(None, dt.datetime(2100, 1, 1), None, None)]
    for rows in [*files, control]:
        _land(_events(spark, rows), base, "in")
        stream = build(K.file_stream(spark, f"{base}/in", _events(spark, []).schema))
        progress += K.run_available_now(stream, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").filter(F.col("t") < Q.CONTROL_US).collect(), progress


def test_misses_of_shuffled_files_equal_the_batch_rule(spark, shuffled, tmp_path):
    files, by_user = shuffled
    K.use_rocksdb(spark)
    out, _ = _drain(spark, files, str(tmp_path), lambda s: K.stream_misses(s, 2, "user_id", "event_id", "ts", "miss"))
    want = set()
    for user, seq in by_user.items():
        run = 0
        for eid, _, _, miss in seq:
            run = run + 1 if miss else 0
            want.add((user, eid, run, run >= 2, miss))
    assert {(r.key, r.id, r.run, r.flag, r.miss) for r in out} == want and len(out) == 400


def test_misses_are_forgotten_after_a_pause(spark, tmp_path):
    K.use_rocksdb(spark)
    rows = [(i, T0 + dt.timedelta(minutes=m), 1, True) for i, m in enumerate((0, 10, 69, 129, 130))]
    out, _ = _drain(spark, [rows], str(tmp_path),
                    lambda s: K.stream_misses(s, 2, "user_id", "event_id", "ts", "miss", forget_seconds=3600))
    assert [r.run for r in sorted(out, key=lambda r: r.id)] == [1, 2, 3, 1, 2]


def test_history_of_shuffled_files_and_idle_state_goes(spark, shuffled, tmp_path):
    files, by_user = shuffled
    K.use_rocksdb(spark)
    pol = DEFAULT_POLICY.with_(session_ttl_seconds=240, max_turns_per_session=5, messages_per_turn=2, max_history_turns=2)
    out, progress = _drain(spark, files, str(tmp_path),
                           lambda s: K.stream_history_state(s, pol, "user_id", "event_id", "ts"))
    want = set()
    for user, seq in by_user.items():
        kept, last = [], None
        for eid, ts, *_ in seq:
            if kept and (ts - last).total_seconds() >= 240:
                kept = []
            capped = len(kept) >= 5
            if not capped:
                kept, last = (kept + [eid, eid])[-8:], ts
            want.add((user, eid, capped, tuple(kept)))
    assert {(r.key, r.id, r.flag, tuple(r.kept)) for r in out} == want and len(out) == 400
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    # the lists and timers of three users; those of the control row alone are left
    assert max(held) >= 12 and held[-1] <= 4
    left = spark.read.format("statestore").option("stateVarName", "stored").load(f"{tmp_path}/ckpt")
    assert left.count() == 0


def test_late_rows_change_the_report_not_the_windows(spark, tmp_path):
    base = str(tmp_path)
    rows = [(i, T0 + dt.timedelta(hours=i), i % 3, False) for i in range(100)]
    late = [(1000 + i, T0 + dt.timedelta(hours=i), 1, False) for i in range(7)]
    progress = []
    for part in (rows[:50], rows[50:], late, [(None, dt.datetime(2100, 1, 1), None, None)]):
        _land(_events(spark, part), base, "in")
        s = K.watched(K.file_stream(spark, f"{base}/in", _events(spark, []).schema))
        progress += K.run_available_now(K.stream_outcome_windows(s, "user_id"), f"{base}/out", f"{base}/ckpt")
    report = K.late_row_report(spark, progress).collect()
    assert sum(r.n_arrived for r in report) == 108
    assert [r.n_arrived for r in report if r.n_dropped] == [7]
    got = spark.read.parquet(f"{base}/out").filter(F.col("w.start") < "2099-01-01").agg(F.sum("n")).first()[0]
    assert got == 100


def test_exact_rate_limit(spark):
    rng = random.Random(2)
    rows = [(i, T0 + dt.timedelta(milliseconds=rng.randrange(600_000)), rng.choice((1, 1, 1, 2, None)), False) for i in range(300)]
    rows += [(900, T0, 7, False), (901, T0 + dt.timedelta(seconds=60), 7, False),
             (902, T0 + dt.timedelta(seconds=120, microseconds=-1), 7, False), (903, None, 7, False)]
    got = {r.event_id: (r.n_last_minute, r.over_limit) for r in K.rate_limit_exact(_events(spark, rows), 1).collect()}
    assert len(got) == len(rows)
    for eid, ts, user, _ in rows:
        n = 0 if ts is None else sum(1 for _, t, u, _ in rows if u == user and t is not None
                                     and dt.timedelta(0) <= ts - t < dt.timedelta(seconds=60))
        assert got[eid] == (n, n > 1)


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_index long, contents string")


def _table(spark, path):
    return sorted(((r.doc_id, r.chunk_index, r.contents) for r in S.current_chunks(spark, path).collect()), key=str)


def test_chunk_store(spark, tmp_path):
    path = str(tmp_path / "store")
    none = _chunks(spark, [])
    S.create_store(spark, path, none.schema)
    assert _table(spark, path) == [] and S.compact_chunks(spark, path) == -1
    files = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    first = _chunks(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "n")])
    S.apply_batch(path, 0, files(1, 2, None), first)
    S.apply_batch(path, 0, files(1, 2, None), first)  # a replay
    assert _table(spark, path) == sorted([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "n")], key=str)
    S.apply_batch(path, 1, files(1, 3), _chunks(spark, [(1, 0, "A"), (3, 0, "d")]))  # file 1 has shrunk
    want = sorted([(1, 0, "A"), (2, 0, "c"), (3, 0, "d"), (None, 0, "n")], key=str)
    assert _table(spark, path) == want
    assert S.compact_chunks(spark, path) == 1 and _table(spark, path) == want
    assert S.compact_chunks(spark, path) == 1 and _table(spark, path) == want
    S.apply_batch(path, 2, files(2, None), none)  # no chunk left in either
    assert _table(spark, path) == [(1, 0, "A"), (3, 0, "d")]
    # a merge that broke off before its commit is not read
    first.write.parquet(f"{path}/base/upto=2")
    assert _table(spark, path) == [(1, 0, "A"), (3, 0, "d")]
    assert S.compact_chunks(spark, path) == 2 and _table(spark, path) == [(1, 0, "A"), (3, 0, "d")]


def test_newest_version_of_a_batch(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "x"), (None, 3, "y")],
                               "doc_id long, version long, text string")
    assert sorted(r.text for r in S.newest_versions(df, "version").collect()) == ["c", "x", "y"]


def test_stream_upsert_with_merges(spark, tmp_path):
    base = str(tmp_path)
    schema = "doc_id long, version long, text string"
    S.create_store(spark, base + "/store", _chunks(spark, []).schema)

    def ingest(batch):
        parts = batch.select("doc_id", F.posexplode(F.split("text", " ")).alias("chunk_index", "contents"))
        return batch, parts.filter("contents <> ''").select("doc_id", F.col("chunk_index").cast("long"), "contents")

    for rows in ([(1, 1, "a b c"), (2, 1, "d")], [(1, 2, "e"), (1, 1, "old"), (3, 1, "f g")], [(2, 2, "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
        S.stream_upsert(K.file_stream(spark, base + "/in", spark.createDataFrame([], schema).schema), base + "/store",
                        base + "/ckpt", ingest, version_col="version", compact_every=2)
    assert _table(spark, base + "/store") == [(1, 0, "e"), (3, 0, "f"), (3, 1, "g")]
    assert spark.read.parquet(base + "/store/commits").agg(F.max("upto")).first()[0] == 1

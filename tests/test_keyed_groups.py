"""Event-time streams whose keys share the state calls of a group."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from railyard.plans import catalog
from railyard.policy import DEFAULT_POLICY
from railyard.streaming import streams as K

Q = catalog.q_streaming
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, miss boolean"
USERS = (None, *range(-3, 36))


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    K.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="module")
def files():
    """Three files of events of 40 users, out of order by up to 50 minutes."""
    rng = random.Random(8)
    rows = [(i, T0 + dt.timedelta(minutes=i, seconds=rng.randrange(60)), rng.choice(USERS), rng.random() < 0.6)
            for i in range(900)]
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(50)))
    return [arrival[i * 300:(i + 1) * 300] for i in range(3)]


def _by_user(files):
    out = {}
    for r in sorted((r for rows in files for r in rows), key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out


def _drain(spark, files, base, build):
    progress = []
    for rows in [*files, [(None, dt.datetime(2100, 1, 1), None, None)]]:
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        progress += K.run_available_now(build(K.file_stream(spark, f"{base}/in", df.schema)), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").filter(F.col("t") < Q.CONTROL_US).collect(), progress


def test_state_entries_follow_the_groups_not_the_keys(spark, files, tmp_path):
    pol = DEFAULT_POLICY.with_(session_ttl_seconds=7200, max_turns_per_session=3, messages_per_turn=1)
    out, progress = _drain(spark, files, str(tmp_path),
                           lambda s: K.stream_history_state(s, pol, "user_id", "event_id", "ts", groups=2))
    want = set()
    for user, seq in _by_user(files).items():
        kept, last = [], None
        for eid, ts, *_ in seq:
            if kept and (ts - last).total_seconds() >= 7200:
                kept = []
            capped = len(kept) >= 3
            if not capped:
                kept, last = kept + [eid], ts
            want.add((user, eid, capped, tuple(kept)))
    assert {(r.key, r.id, r.flag, tuple(r.kept)) for r in out} == want and len(out) == 900
    # of each group: rows that wait, stored sessions, the timer's time and its two entries or a stale timer's
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert 0 < max(held) <= 16
    assert spark.read.format("statestore").option("stateVarName", "stored").load(f"{tmp_path}/ckpt").count() == 0


def test_cache_and_misses_of_one_group(spark, files, tmp_path):
    hits, _ = _drain(spark, files, str(tmp_path / "k6"),
                     lambda s: K.stream_embedding_dedup(s, 7200, "user_id", "event_id", "ts", groups=1))
    runs, _ = _drain(spark, files, str(tmp_path / "k8"),
                     lambda s: K.stream_misses(s, 2, "user_id", "event_id", "ts", "miss", forget_seconds=5400, groups=1))
    want_hits, want_runs = set(), set()
    for seq in _by_user(files).values():
        expiry, run, last = T0, 0, None
        for eid, ts, _, miss in seq:
            want_hits.add((eid, ts < expiry))
            if ts >= expiry:
                expiry = ts + dt.timedelta(hours=2)
            if run and (ts - last).total_seconds() >= 5400:
                run = 0
            run, last = (run + 1 if miss else 0), ts
            want_runs.add((eid, run, run >= 2))
    assert {(r.id, r.flag) for r in hits} == want_hits and len(hits) == 900
    assert {(r.id, r.run, r.flag) for r in runs} == want_runs and len(runs) == 900


def test_groups_grow_with_the_rows(spark):
    assert Q.key_groups(spark.range(10)) == 16
    assert Q.key_groups(spark.range(100 * Q.GROUP_ROWS + 1)) == 101

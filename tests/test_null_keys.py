"""Rows with null keys or null order columns, odd vectors and typed metadata."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from railyard.functions.vectors import unit_rows
from railyard.operators import conversation as J
from railyard.operators import embed, metadata as B, reports
from railyard.operators.input_guards import pii_label
from railyard.policy import DEFAULT_POLICY
from railyard.sources.chunk_table import delete_chunks, upsert_chunks

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session_id string, turn long, role string, text string, ts timestamp_ntz"
ROWS = [("a", 0, "user", "hi", T0), ("a", 1, "user", "hi", None), (None, 0, "user", "hi", T0),
        (None, 1, "assistant", "yes", T0 + dt.timedelta(hours=2)), ("b", None, "user", "hi", T0)]


def test_running_forms_keep_every_row(spark):
    m = spark.createDataFrame(ROWS, SCHEMA)
    assert J.expire_sessions(m, 3600).count() == 5
    assert J.session_cap(m, 3).count() == 5
    assert J.trim_history_tokens(m.withColumn("tokens", F.lit(1)), 10).count() == 5
    assert J.condenser_input(m).count() == 4
    assert {r["session_id"] for r in J.load_history(m, "2024-01-01 02:30:00").collect()} >= {None}
    folded = J.session_fold(m.withColumn("input_ok", F.lit(True)).withColumn("eligible", F.lit(True)))
    assert folded.count() == 5
    assert reports.repeat_question_report(m, "session_id", "turn", "text").count() == 1
    replay = embed.embedding_cache_replay(m.withColumn("rid", F.monotonically_increasing_id()), "session_id", "ts", "rid")
    assert replay.filter("session_id is null").count() == 2


def test_null_session_epochs(spark):
    m = spark.createDataFrame(ROWS, SCHEMA).filter("session_id is null")
    assert sorted(r["epoch"] for r in J.expire_sessions(m, 3600).collect()) == [0, 1]


def test_one_odd_vector_leaves_the_others():
    rows, ok = unit_rows([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0, 1.0], None], 2)
    assert ok.tolist() == [True, True, False, False]
    assert np.allclose(rows[1], [0, 1])
    assert unit_rows([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0, 1.0]])[1].tolist() == [True, True, False]


def test_typed_metadata(spark):
    df = spark.createDataFrame([(1, {"k": "7", "b": "true"}), (2, {"k": "abc", "b": "false"}), (3, {})],
                               "id long, metadata map<string,string>")
    m = F.col("metadata")

    def ids(cond):
        return [r["id"] for r in df.filter(cond).orderBy("id").collect()]

    assert ids(B.Pred("k", ">", 5).column(m)) == [1]
    assert ids(B.filter_metadata(m, {"b": True})) == [1]
    assert ids(B.Pred("b", "==", False).column(m)) == [2]
    assert [r["id"] for r in delete_chunks(df, metadata_filter={"k": 7}).orderBy("id").collect()] == [2, 3]
    assert delete_chunks(df, delete_all=True).count() == 0


def test_upsert_of_equal_versions_is_deterministic(spark):
    base = spark.createDataFrame([("x", "old")], "id string, v string")
    new = [("x", "b"), ("x", "c"), ("x", "a")]
    for rows in (new, new[::-1]):
        got = upsert_chunks(base, spark.createDataFrame(rows, "id string, v string").withColumn("ver", F.lit(1)),
                            "id", "ver").collect()
        assert [tuple(r) for r in got] == [("x", "c", 1)]


def test_first_seen_turn_is_the_earliest(spark):
    dropped = spark.createDataFrame([("s", 5, 0, "c")], "session_id string, turn long, pos long, chunk_id string")
    seen = spark.createDataFrame([("s", 1, "c"), ("s", 3, "c")], "session_id string, turn long, chunk_id string")
    assert reports.stale_citation_report(dropped, seen).first()["first_seen_turn"] == 1


def test_policy_patterns_can_be_changed(spark):
    policy = DEFAULT_POLICY.with_(pii_patterns=(("badge", r"B-\d+"),))
    df = spark.createDataFrame([("my badge B-12",), ("a@b.com",)], "t string")
    assert [r[0] for r in df.select(pii_label("t", policy)).collect()] == ["badge", None]

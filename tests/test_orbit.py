"""Pointer orbits and what is built on them: packing (C2), the session cap (J5
in J13); exact quantiles (G3) and user token counters (C4)."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import twins
from railyard.functions import orbit as orbit_module
from railyard.functions.orbit import orbit
from railyard.functions.quantiles import exact_quantiles
from railyard.functions.text import token_count
from railyard.operators import chunking as C
from railyard.operators import conversation as J
from railyard.plans.retrieval import search_candidates
from railyard.policy import DEFAULT_POLICY
from railyard.session import materialized

T0 = dt.datetime(2024, 1, 1)


def walk(nxt):
    out, i = [], 0
    while i is not None and i < len(nxt):
        out.append(i)
        i = nxt[i]
    return out


@pytest.mark.parametrize("block", [2, 7, 64, 5000])
def test_orbit_equals_a_walk(spark, block):
    rng = random.Random(block)
    keys = {("a", 1): 300, ("a", None): 41, (None, 1): 1, ("b", 2): block, ("c", 3): 2 * block if block < 100 else 3}
    rows, want = [], {}
    for (a, b), n in keys.items():
        nxt = [None if rng.random() < 0.004 else i + rng.choice((1, 1, 2, 3, 9, 40)) for i in range(n)]
        rows += [(a, b, i, x) for i, x in enumerate(nxt)]
        want[a, b] = walk(nxt)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b long, idx long, next long")
    got = {}
    for r in orbit(materialized(df, "t"), ["a", "b"], block=block).orderBy("nth").collect():
        assert r.nth == len(got.setdefault((r.a, r.b), []))
        got[r.a, r.b].append(r.idx)
    assert got == want


def test_orbit_of_nothing(spark):
    df = spark.createDataFrame([], "k long, idx long, next long")
    assert orbit(df, ["k"]).count() == 0


def _blocks(spark, lens, doc=1):
    rows = [(doc, i, "paragraph", None, "x" * n) for i, n in enumerate(lens)]
    return spark.createDataFrame(rows, "doc_id long, pos long, kind string, level int, text string")


def greedy(tokens, limit):
    out, total = [], None
    for t in tokens:
        if total is None or total + t > limit:
            out.append([t])
            total = t
        else:
            out[-1].append(t)
            total += t
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_one_huge_heading_group(spark, monkeypatch, block):
    """Thousands of blocks of one group, over many stretches and orbit blocks."""
    monkeypatch.setattr(orbit_module.orbit, "__defaults__", ("idx", "next", block))
    rng = random.Random(1)
    lens = [rng.choice((1, 3, 9, 40, 77, 200)) for _ in range(1500 if block == 4 else 9000)]
    lens[700:760] = [1] * 60
    got = C.pack_chunks(C.attach_headings(_blocks(spark, lens)), 50).orderBy("chunk_no").collect()
    want = greedy([max(1, n // 4) for n in lens], 50)
    assert [r.chunk_no for r in got] == list(range(len(want)))
    assert [(r.raw_tokens, r.n_blocks) for r in got] == [(sum(c), len(c)) for c in want]
    assert [len(r.raw_text) for r in got][:-1] == _text_sizes(lens, want)[:-1]


def _text_sizes(lens, chunks):
    out, i = [], 0
    for c in chunks:
        out.append(sum(lens[i:i + len(c)]) + len(c) - 1)
        i += len(c)
    return out


def test_pack_plan_gathers_no_group(spark):
    """Tokens are not collected by (document, heading group)."""
    plan = C._next_starts(C.split_oversized(C.attach_headings(_blocks(spark, [5] * 9)), 50), 50)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_null_document_is_packed(spark):
    got = C.pack_chunks(C.attach_headings(_blocks(spark, [40, 40, 40], doc=None)), 20).orderBy("chunk_no").collect()
    assert [(r.doc_id, r.n_blocks) for r in got] == [(None, 2), (None, 1)]


def test_user_token_counter(spark):
    def by_letters(texts):
        return [t.count("x") for t in texts]

    df = spark.createDataFrame([(1, "xx y"), (2, None), (3, "yyy"), (4, "")], "id long, text string")
    assert [r.n for r in df.orderBy("id").select(token_count("text", by_letters).alias("n")).collect()] == [2, 1, 1, 1]
    lens = [30, 30, 5, 80, 10, 10, 10]
    got = C.pack_chunks(C.attach_headings(_blocks(spark, lens)), 64, by_letters).orderBy("chunk_no").collect()
    assert [(r.raw_tokens, r.n_blocks) for r in got] == [(60, 2), (5, 1), (80, 1), (30, 3)]
    ctx = C.contextualize(C.pack_chunks(C.attach_headings(_blocks(spark, lens)), 64, by_letters), 64, by_letters)
    assert sorted(r.contextualized_tokens for r in ctx.collect()) == [5, 30, 60, 80]
    msgs = spark.createDataFrame([(1, i, "x" * 10) for i in range(5)], "session_id long, turn long, text string")
    assert [r.turn for r in J.trim_history_tokens(msgs, 25, counter=by_letters).orderBy("turn").collect()] == [3, 4]
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "xxxxx", "f", "t")], "id long, embedding array<double>, content string, "
                                   "filename string, file_type string")
    q = corpus.select(F.col("id").alias("query_id"), "embedding")
    assert search_candidates(q, corpus, 1, counter=by_letters).first().token_count == 5


@pytest.mark.parametrize("sizes", [(1, 2, 3), (2, 40, 1), (1500,)])
def test_session_cap_of_hot_sessions(spark, sizes, monkeypatch):
    monkeypatch.setattr(orbit_module.orbit, "__defaults__", ("idx", "next", 16))
    rng = random.Random(sum(sizes))
    ttl, rows = 1800, []
    for s, n in enumerate(sizes):
        at = 0
        for i in range(n):
            at += rng.choice((0, 1, 60, 600, 1799, 1800, 2500))
            ok = rng.random() < 0.9
            rows.append((None if s == 1 else s, i, T0 + dt.timedelta(seconds=at), ok, ok and rng.random() < 0.8))
    schema = "session_id long, turn long, ts timestamp_ntz, input_ok boolean, eligible boolean"
    df = spark.createDataFrame(rows, schema)
    for cap, per in ((5, 2), (1, 1), (8, 1)):
        pol = DEFAULT_POLICY.with_(session_ttl_seconds=ttl, max_turns_per_session=cap, messages_per_turn=per, max_history_turns=3)
        got = {(r.session_id, r.turn): r.capped for r in J.session_fold(df, pol).collect()}
        for s in {r[0] for r in rows}:
            seq = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
            want = twins.session_fold([(int((r[2] - T0).total_seconds() * 1e6), r[3], r[4]) for r in seq], ttl * 1_000_000,
                                      cap, per, pol.history_cap)
            assert [got[s, r[1]] for r in seq] == want


def test_session_cap_limits(spark):
    rows = [(1, i, T0, True, True) for i in range(9)] + [(1, 9, None, True, True)]
    df = spark.createDataFrame(rows, "session_id long, turn long, ts timestamp_ntz, input_ok boolean, eligible boolean")
    count = lambda **kw: J.session_fold(df, DEFAULT_POLICY.with_(**kw)).filter("capped").count()
    assert count(max_turns_per_session=0) == 10
    assert count(max_turns_per_session=9, max_history_turns=1) == 0  # the store is trimmed to 4
    assert count(max_turns_per_session=4, messages_per_turn=2, max_history_turns=1) == 7  # the turn without a time is not


@pytest.mark.parametrize("width", [2.0 ** -15, 0.3, 100.0])
def test_quantiles_are_exact(spark, width):
    rng = np.random.default_rng(0)
    groups = {"a": rng.random(401), "b": np.r_[np.full(300, 0.25), rng.normal(size=7)], "c": np.array([0.5]),
              None: np.array([-3.0, 1.5, 1.5, 9.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r.g: tuple(r[1:]) for r in exact_quantiles(df, "g", "v", probs, width).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, probs))

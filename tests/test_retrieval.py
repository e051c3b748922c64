"""Retrieval guards, output guards and search on inline fixtures."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import twins
from railyard.operators import output_guards as OG
from railyard.operators import retrieval_guards as RG
from railyard.operators import search as S
from railyard.policy import DEFAULT_POLICY

SCHEMA = "query_id long, chunk_id long, content string, distance double, filename string, file_type string, token_count long"
POL = DEFAULT_POLICY.with_(distance_threshold=0.45, top_k=3, max_context_tokens=100,
                           filename_allowlist=None, filetype_allowlist=(".pdf", ".docx"))

# query 1: empty, blank, null / upper-case type, distance at and above threshold, null distance
# query 2: more than k rows with a tie; query 3: budget met exactly, overflow then a smaller chunk
# query 4: a row failing two stages (empty and bad type) counts once, at the first
ROWS = [
    (1, 1, "", 0.1, "a", ".pdf", 1), (1, 2, "  \t", 0.1, "a", ".pdf", 1), (1, 3, "x", 0.2, "a", None, 1),
    (1, 4, "x", 0.2, "a", ".PDF", 1), (1, 5, "x", 0.45, "a", ".pdf", 1), (1, 6, "x", 0.4500001, "a", ".pdf", 1),
    (1, 7, "x", None, "a", ".pdf", 1),
    (2, 10, "x", 0.3, "a", ".pdf", 1), (2, 11, "x", 0.1, "a", ".docx", 1), (2, 12, "x", 0.2, "a", ".pdf", 1),
    (2, 13, "x", 0.2, "a", ".pdf", 1), (2, 14, "x", 0.05, "a", ".pdf", 1),
    (3, 20, "x", 0.1, "a", ".pdf", 60), (3, 21, "x", 0.2, "a", ".pdf", 40), (3, 22, "x", 0.3, "a", ".pdf", 1),
    (4, 30, "", 0.1, "a", ".txt", 1), (4, 31, "x", 0.1, "a", ".txt", 1),
]
QUERIES = [1, 2, 3, 4, 5]


def _twin(rows, qid, pol):
    rs = [dict(zip(["query_id", "chunk_id", "content", "distance", "filename", "file_type", "token_count"], r))
          for r in rows if r[0] == qid]
    return twins.retrieval_guards(rs, k=pol.top_k, threshold=pol.distance_threshold, budget=pol.max_context_tokens,
                                  fn_allow=None if pol.filename_allowlist is None else set(pol.filename_allowlist),
                                  ft_allow={t.lower() for t in pol.filetype_allowlist})


def _run(spark, rows, pol):
    hits = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(q,) for q in sorted({r[0] for r in rows} | set(QUERIES))], "query_id long")
    return {r["query_id"]: r for r in RG.apply_retrieval_guards(hits, q, pol).collect()}


def test_retrieval_guards_fixture(spark):
    got = _run(spark, ROWS, POL)
    for qid in QUERIES:
        ids, used, dropped = _twin(ROWS, qid, POL)
        r = got[qid]
        assert list(r["chunk_ids"]) == ids
        assert r["total_context_tokens"] == used
        assert dict(r["dropped_counts"]) == dropped
        assert r["no_context"] == (len(ids) == 0)
    assert list(got[3]["chunk_ids"]) == [20, 21]          # budget met exactly, 22 stays out
    assert got[4]["dropped_empty"] == 1 and got[4]["dropped_metadata"] == 1
    assert got[5]["no_context"] and got[5]["total_context_tokens"] == 0


ROW = st.tuples(st.integers(1, 3), st.sampled_from(["", " ", "x"]),
                st.one_of(st.none(), st.sampled_from([0.1, 0.2, 0.3, 0.45, 0.5])),
                st.sampled_from([None, "a", "b"]), st.sampled_from([None, ".pdf", ".PDF", ".txt"]),
                st.integers(0, 60))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, max_size=25), st.integers(-1, 4), st.sampled_from([None, ("a",)]))
def test_retrieval_guards_generated(spark, raw, k, fn_allow):
    rows = [(q, i, c, d, fn, ft, t) for i, (q, c, d, fn, ft, t) in enumerate(raw)]
    pol = POL.with_(top_k=k, filename_allowlist=fn_allow)
    got = _run(spark, rows, pol) if rows else {}
    for qid in {r[0] for r in rows}:
        ids, used, dropped = _twin(rows, qid, pol)
        assert list(got[qid]["chunk_ids"]) == ids
        assert got[qid]["total_context_tokens"] == used
        assert dict(got[qid]["dropped_counts"]) == dropped


def test_format_context_no_context(spark):
    g = RG.format_context(RG.apply_retrieval_guards(
        spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([(1,), (5,)], "query_id long"), POL))
    ctx = {r["query_id"]: r["context"] for r in g.collect()}
    assert ctx[5] == "NO_CONTEXT"
    assert ctx[1].startswith('[{"chunk_id":4,') and '"distance":0.2' in ctx[1]


CIT = "array<struct<chunk_id:string,source:string,score:double>>"


def test_output_guards_fixture(spark):
    c = lambda *ids: [(i, None, None) for i in ids]
    answers = spark.createDataFrame([
        (1, "fine answer", c("a"), True, False),             # valid
        (2, "one bad", c("a", "zz", "b"), True, False),      # one bad among good
        (3, "all bad", c("zz", "yy", "zz"), True, False),    # all bad, duplicate bad ids
        (4, "none", c(), True, False),                       # empty with enough_context
        (5, "unsure", c("a"), False, False),                 # enough_context false
        (6, "mail x@y.io damn", c("a"), True, False),        # PII and profanity in body
        (7, "stale", c("old"), True, False),                 # id retrieved in an earlier turn only
    ], f"turn_id long, answer string, citations {CIT}, enough_context boolean, needs_human boolean")
    retrieved = spark.createDataFrame(
        [(t, x, f"f{x}", 0.1) for t in (1, 2, 3, 4, 5, 6) for x in ("a", "b")] + [(6, "old", "f", 0.2)],
        "turn_id long, chunk_id string, filename string, distance double")
    g = OG.apply_output_guards(OG.filter_citations(answers, retrieved)).collect()
    r = {x["turn_id"]: x for x in g}
    assert [c["chunk_id"] for c in r[2]["citations"]] == ["a", "b"] and list(r[2]["dropped_citations"]) == ["zz"]
    assert list(r[3]["dropped_citations"]) == ["zz", "yy", "zz"] and r[3]["ungrounded"]
    assert r[4]["ungrounded"] and r[4]["body_suppressed"]
    assert list(r[4]["flagged_stages"]) == ["grounding"]
    assert not r[5]["ungrounded"] and r[5]["body_suppressed"] and list(r[5]["flagged_stages"]) == ["enough_context_false"]
    assert r[6]["scrubbed_answer"] == "mail [redacted] ****" and list(r[6]["flagged_stages"]) == ["pii_scrub", "profanity_scrub"]
    assert r[7]["ungrounded"] and list(r[7]["flagged_stages"]) == ["citation_integrity", "grounding"]
    assert r[1]["final_body"] == "fine answer" and not r[1]["flagged_stages"]
    b = {x["turn_id"]: x for x in OG.backfill_citations(answers, retrieved).collect()}
    assert [(c["chunk_id"], c["source"], c["score"]) for c in b[2]["citations"]] == [
        ("a", "fa", 0.1), ("zz", None, None), ("b", "fb", 0.1)]


def test_latest_retrieval_replaces(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "turn_id long, call_no int, chunk_id string")
    got = sorted((r["turn_id"], r["chunk_id"]) for r in RG.latest_retrieval(calls).collect())
    assert got == [(1, "b"), (2, "c")]


def _brute_topk(q, c, k, exclude_self):
    n = np.linalg.norm(q, axis=1, keepdims=True)
    qn = np.divide(q, n, out=np.zeros_like(q), where=n > 0)
    cn = np.linalg.norm(c, axis=1)
    out = {}
    for i in range(len(q)):
        res = []
        for j in range(len(c)):
            if exclude_self and i == j:
                continue
            d = None if cn[j] == 0 else 1.0 - float(qn[i] @ (c[j] / cn[j]))
            res.append((float("inf") if d is None else d, j))
        res.sort()
        out[i] = [j for _, j in res[:k]]
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
def test_topk_batch_brute_force(spark, exclude_self):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 8))
    c[7] = 0.0                     # zero vector: null distance, sorted last
    c[11] = c[12]                  # exact tie, broken by id
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)],
                                   "id long, embedding array<float>").repartition(3)
    q = c[:40].astype(np.float32).astype(np.float64)
    c32 = c.astype(np.float32).astype(np.float64)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)],
                                    "query_id long, embedding array<float>").filter("query_id != 7")
    got = S.vector_topk_batch(corpus, queries, 5, exclude_self=exclude_self).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        res.setdefault(r["query_id"], []).append(r["id"])
    want = _brute_topk(q, c32, 5, exclude_self)
    for i in res:
        assert res[i] == want[i]
    assert 7 not in res and len(res) == 39


def test_topk_plans(spark):
    e = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(50)], "id long, embedding array<float>")
    one = S.vector_topk(e, [1.0, 0.0], 3)
    assert "TakeOrderedAndProject" in one._jdf.queryExecution().executedPlan().toString()
    batch = S.vector_topk_batch(e, e.select(F.col("id").alias("query_id"), "embedding"), 3)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoopJoin" not in plan
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan
    assert "Broadcast" not in plan and "RDDScan" not in plan.split("MapInArrow")[0]


def test_ivf_all_cells_is_exact_and_plan_is_cogroup(spark):
    from railyard.operators.ann import ann_index_build, ann_topk
    rng = np.random.default_rng(5)
    c = rng.normal(size=(400, 8))
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)],
                                   "id long, embedding array<float>")
    queries = corpus.select(F.col("id").alias("query_id"), "embedding").filter("query_id < 30")
    idx = ann_index_build(corpus, 6, seed=3)
    exact = {(r["query_id"], r["id"]) for r in S.vector_topk_batch(corpus, queries, 4).collect()}
    full = ann_topk(idx, queries, 4, nprobe=6, query_block=7, row_block=20)  # both sides of a cell cut
    assert {(r["query_id"], r["id"]) for r in full.collect()} == exact
    part = ann_topk(idx, queries, 4, nprobe=2)
    assert part.count() == 30 * 4
    plan = ann_topk(idx, queries, 4, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert "Cartesian" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall_holds_as_the_table_grows(spark, sf):
    from railyard.plans.registry import queries
    assert queries()["ann_recall"](spark, f"/root/testdata/{sf}").first()["mean_recall"] >= 0.9


def test_nprobe_is_kept_with_the_index(spark):
    from railyard.operators.ann import ann_index_open_or_build
    rng = np.random.default_rng(6)
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))],
                                   "id long, embedding array<float>")
    built, opened = (ann_index_open_or_build(corpus, "nprobe-test") for _ in range(2))
    assert 1 <= opened.nprobe == built.nprobe <= len(opened.centroids)


def test_topk_blocks_agree(spark):
    """Small blocks, text ids, vectors of other lengths, nulls, repeated rows and ties."""
    rng = np.random.default_rng(9)
    rows = [(str(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    rows += [("9", [1.0, 0.0, 0.0, 0.0]), ("10", [1.0, 0.0, 0.0, 0.0]), ("x", [1.0] * 3), ("y", None),
             ("z", []), ("w", [float("nan")] * 4), (None, [1.0] * 4)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(str(i), v) for i, v in rows[:60]] + [("3d", [1.0, 2.0, 3.0]), ("none", None)],
                                    "query_id string, embedding array<double>")
    for exclude in (False, True):
        one = S.vector_topk_batch(corpus, queries, 6, exclude_self=exclude)
        cut = S.vector_topk_batch(corpus, queries, 6, exclude_self=exclude, query_block=7, row_block=11)
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in one.collect())
        assert got == sorted((r["query_id"], r["rank"], r["id"]) for r in cut.collect())
        assert len({q for q, _, _ in got} & {"none"}) == 0 and ("3d", 1, "x") in got
        want = []
        for qid, q in [(str(i), v) for i, v in rows[:60]]:
            if not any(q):
                continue
            ds = []
            for cid, c in rows:
                if cid is None or exclude and cid == qid:
                    continue
                ok = c is not None and len(c) == 4 and np.isfinite(c).all() and any(c)
                d = 1 - np.dot(q, c) / np.linalg.norm(q) / np.linalg.norm(c) if ok else np.inf
                ds.append((round(float(d), 9), cid))
            want += [(qid, n + 1, d) for n, (d, _) in enumerate(sorted(ds)[:6])]
        dist = sorted((r["query_id"], r["rank"], round(r["distance"], 9) if r["distance"] is not None else np.inf)
                      for r in cut.collect() if r["query_id"] != "3d")
        assert [(a, b) for a, b, _ in dist] == [(a, b) for a, b, _ in sorted(want)]
        assert np.allclose([d for *_, d in dist], [d for *_, d in sorted(want)], atol=1e-7)


def test_dropped_index_searches_flat_rows(spark):
    from railyard.operators.ann import ann_index_build, ann_index_drop, ann_topk
    corpus = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0]) for i in range(60)],
                                   "id long, embedding array<float>")
    queries = corpus.select(F.col("id").alias("query_id"), "embedding")
    idx = ann_index_build(corpus, 4)
    ann_index_drop(idx)
    assert sorted(map(tuple, ann_topk(idx, queries, 3).collect())) == sorted(
        map(tuple, S.vector_topk_batch(corpus, queries, 3).collect()))


def test_stream_window_drops_late_rows(spark, tmp_path):
    import datetime as dt
    import os
    from railyard.streaming import streams as K
    base = str(tmp_path)
    src = os.path.join(base, "in")
    t0 = dt.datetime(2024, 1, 1)
    first = [(1, t0 + dt.timedelta(minutes=m), "a") for m in (0, 1, 2)] + [(2, t0 + dt.timedelta(days=2), "a")]
    spark.createDataFrame(first, "id long, ts timestamp_ntz, kind string").coalesce(1).write.parquet(src)
    # late rows are filtered with the previous batch's watermark, so the late
    # row comes two files (batches) after the one that moves the watermark
    for rows in ([(4, t0 + dt.timedelta(days=3), "b")], [(3, t0 + dt.timedelta(minutes=5), "a")]):
        spark.createDataFrame(rows, "id long, ts timestamp_ntz, kind string").coalesce(1).write.mode(
            "append").parquet(src)
    schema = "id long, ts timestamp_ntz, kind string"
    from pyspark.sql import types as T
    st_schema = T._parse_datatype_string(schema)
    s = K.stream_outcome_windows(K.file_stream(spark, src, st_schema, 1), "kind", window="1 day", watermark="1 hour")
    q = (s.writeStream.format("memory").queryName("late_test").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = {(r["w"]["start"].day, r["kind"]): r["n"] for r in spark.sql("select * from late_test").collect()}
    # the 00:05 row arrived after the watermark passed day 1: dropped, day-1 count stays 3
    assert rows[(1, "a")] == 3
    def drops(p):
        ops = p["stateOperators"] if isinstance(p, dict) else p.stateOperators
        return sum((o["numRowsDroppedByWatermark"] if isinstance(o, dict) else o.numRowsDroppedByWatermark)
                   for o in (ops or []))
    assert sum(drops(p) for p in q.recentProgress) >= 1


def _clustered(spark, n, dim=16, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(centres, size=n)] + rng.normal(scale=0.05, size=(n, dim))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")


def test_pruned_search_is_exact_and_visits_little_of_clusters(spark):
    from railyard.operators.ann import ann_index_build, ann_topk_pruned
    x, corpus = _clustered(spark, 3000)
    index = ann_index_build(corpus)
    asked = corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in ann_topk_pruned(index, asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 3000, 20):
        assert got[q] == list(np.argsort(1 - unit @ unit[q], kind="stable")[:10])
    report = ann_topk_pruned(index, asked, 10, report=True).collect()
    assert len(report) == 150 and {r["n_rows"] for r in report} == {3000}
    assert np.mean([r["n_visited"] / 3000 for r in report]) < 0.2


def test_pruned_search_of_unclustered_and_odd_rows(spark):
    from railyard.operators.ann import ann_index_build, ann_topk_pruned
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 6), (901, None), (902, [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = ann_index_build(corpus.filter("id < 902"), ncells=12)
    asked = corpus.select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in ann_topk_pruned(index, asked, 300, first=1).orderBy("query_id", "rank").collect():  # more than two cells hold
        got.setdefault(r["query_id"], []).append(r["id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == set(range(400))
    for q in range(400):
        assert [i for i in got[q] if i < 400][:300] == list(np.argsort(1 - unit @ unit[q], kind="stable")[:300])

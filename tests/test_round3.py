"""Findings of round 3."""

from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import SMOKE
from railyard.operators import block_topk as B
from railyard.plans import q_output


def _brute(ids, vectors, k, exclude_self):
    out = []
    for at, m in B.vectors_by_size(vectors).values():
        unit = dict(zip(at.tolist(), m, strict=True))
        for a, q in unit.items():
            near = [(float(1.0 - np.einsum("ij,ij->i", q[None], unit[p][None])[0]) if p in unit else float("inf"), ids[p].as_py())
                    for p in range(len(ids)) if not exclude_self or ids[p] != ids[a]]
            out += [(ids[a].as_py(), i, None if d == float("inf") else d) for d, i in sorted(near)[:k]]
    return Counter(out)


def test_screened_topk_equals_brute_force():
    """Copies, other lengths, no direction, repeated ids, rows over several tiles."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(20, 90))
        base = rng.integers(-2, 3, (n // 4, 4)).astype(float)
        rows = [None if c == 0 else r[:3] if c == 1 else [0.0] * 4 if c == 2 else [float("nan")] * 4 if c == 3 else r
                for c, r in ((int(rng.integers(0, 9)), list(base[rng.integers(0, len(base))])) for _ in range(n))]
        vectors, raw = pa.array(rows, pa.list_(pa.float64())), rng.integers(0, n, n)
        ids = pa.array(raw) if seed % 2 else pa.array([f"s{x}" for x in raw])
        for exclude_self in (False, True):
            for k, step in ((1, 7), (4, 64), (6, 2048)):
                block = B.QueryBlock(ids, vectors, k, exclude_self)
                for lo in range(0, n, step):
                    block.add(B.Tile(ids.slice(lo, step), pa.concat_arrays([vectors.slice(lo, step)]), k))
                got = Counter(x for b in block.result(ids.type) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
                assert got == _brute(ids, vectors, k, exclude_self), (seed, exclude_self, k, step)


def test_retrieval_is_computed_once(spark):
    """Callers read the retrieved chunks up to three times."""
    plan = q_output.retrieved(spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "MapInArrow" not in q_output.filtered(spark, SMOKE)[0]._jdf.queryExecution().optimizedPlan().toString()


def test_personal_data_decodes_every_character():
    """every stretch of every text reaches the tagger, with or without a digit or @."""
    from railyard.llm import pii_tagger as P

    class Recorder(P.Tagger):
        def decode(self, codes, lengths=None):
            read.extend(int(n) for n in lengths)
            return super().decode(codes, lengths)

    texts = ["", "a", "words and words " * 200, "x" * 511, "y" * 512, "z" * 513, "mail me: john at example.org, thanks"]
    read: list[int] = []
    P.tag_texts(Recorder(), texts)
    assert sum(read) >= sum(map(len, texts))
    for t in texts:
        seen = np.zeros(len(t), bool)
        for a, b in P.stretches(len(t)):
            seen[a:b] = True
            assert b - a <= P.SPAN
        assert seen.all()


def test_personal_data_stretches_do_not_depend_on_their_batch():
    from railyard.llm import pii_tagger as P

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc 0123@.+é"), int(n))) for n in rng.integers(0, 1500, 12)]
    tagger = P.Tagger()
    together = P.tag_texts(tagger, texts)
    assert together == [P.tag_texts(tagger, [t])[0] for t in texts]
    codes = np.stack([P.char_codes("call +1 234 567 8901 now!".ljust(64, "."))])
    e, _ = tagger.emissions(codes)  # double precision, and the path step by step
    score = e[0] + tagger.p["first"]
    for t in range(1, len(e)):
        score = (score[:, :, None] + tagger.p["trans"]).max(1) + e[t]
    path = tagger.decode(codes)[0]
    own = tagger.p["first"][path[0]] + e[0, 0, path[0]] + sum(
        tagger.p["trans"][path[t - 1], path[t]] + e[t, 0, path[t]] for t in range(1, len(e)))
    assert abs(own - score[0].max()) < 1e-3


def test_ivf_sends_a_query_once_per_group_of_cells(spark):
    """what is moved grows with the groups of cells, not with the cells a query searches."""
    from railyard.operators import ann as A

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)], "id long, embedding array<double>")
    index = A.ann_index_build(rows, ncells=12)
    queries = rows.withColumnRenamed("id", "query_id")
    bc = spark.sparkContext.broadcast(index.centroids)
    cells, asked = A._sides(index, queries, "query_id", "embedding")
    for row_block, least in ((1000, 1), (60, 4)):
        groups = A._cell_groups(cells, 12, row_block)
        assert len(set(groups[groups >= 0])) >= least
        sent = asked.mapInArrow(A._nearest_fn(bc, groups, 12), A._probe_schema(asked))
        assert sent.count() == 300 * len(set(groups[groups >= 0]))
        assert sent.selectExpr("sum(size(parts)) n").first()["n"] == 300 * int((groups >= 0).sum())
        exact = A.vector_topk_batch(rows, queries, 4)
        for got in (A.ann_topk(index, queries, 4, nprobe=12, row_block=row_block),
                    A.ann_topk_pruned(index, queries, 4, row_block=row_block)):
            assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == sorted(
                (r.query_id, r.id, r["rank"]) for r in exact.collect())
    # of a query that searches few cells, no row of another cell
    near = asked.mapInArrow(A._nearest_fn(bc, groups, 3), A._probe_schema(asked)).selectExpr("query_id", "explode(parts) part")
    hits = A.ann_topk(index, queries, 4, nprobe=3, row_block=60).join(cells.selectExpr("id", "cell part"), "id")
    assert hits.join(near, ["query_id", "part"], "left_anti").count() == 0

"""Packing moves a text by document once, and places the blocks without it."""

from pyspark.sql import functions as F

from railyard.functions.scan import join_same
from railyard.operators import chunking as C
from railyard.plans import ingest
from railyard.policy import DEFAULT_POLICY

BLOCKS = "doc_id long, pos long, kind string, level int, text string"


def _blocks(spark):
    rows = [(d, p, "heading" if p % 7 == 3 else "paragraph", 1 if p % 7 == 3 else None, f"{d} {p} " * (1 + p % 5 * 9))
            for d in (None, 1, 2) for p in range(30)]
    return spark.createDataFrame(rows, BLOCKS)


def test_no_text_moves_after_the_places_are_known(spark, monkeypatch):
    seen = []
    inner = C._next_starts
    monkeypatch.setattr(C, "_next_starts", lambda p, limit: (seen.append(p.columns), inner(p, limit))[1])
    blocks = C.sized(_blocks(spark), DEFAULT_POLICY.chunk_pack_limit)
    plan = ingest.chunk_documents(blocks)._jdf.queryExecution().executedPlan().toString()
    assert seen and all("text" not in cols for cols in seen)
    first = next(x for x in plan.splitlines() if "Exchange" in x)
    assert "REPARTITION_BY_COL" in first and "doc_id" in first


def test_counted_blocks_pack_alike(spark):
    plain = C.attach_headings(_blocks(spark))
    want = C.pack_chunks(plain, 20)
    got = C.pack_chunks(C.attach_headings(C.sized(_blocks(spark), 20)), 20)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(got) == rows(want) and want.count() > 20
    assert {r.doc_id for r in got.collect()} == {None, 1, 2}


def test_numbers_are_dealt_as_the_null_safe_join_does(spark):
    pieces = spark.createDataFrame([(d, p, 0, t) for d in (None, 1, 1, 2) for p in (0, 1) for t in "a"],
                                   "doc_id long, pos long, sub int, text string")
    places = spark.createDataFrame([(None, 0, 0, 5), (None, 1, 0, 6), (1, 0, 0, 0), (1, 0, 0, 1), (1, 1, 0, 1), (3, 0, 0, 0)],
                                   "doc_id long, pos long, sub int, chunk_no long")
    want = join_same(pieces, places, ["doc_id", "pos", "sub"])
    got = C._dealt(pieces, places).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 8
    assert got.filter(F.col("doc_id") == 2).count() == 0

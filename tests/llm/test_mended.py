"""Special tokens, rare labels and user columns with the names of helper columns."""

from array import array

import numpy as np
import public_tokenizers as P
import pytest
import zlib
from pyspark.sql import functions as F

import corpus_pipeline
from railyard.llm import curriculum, dedup_tree, ngram_join, queries, token_store, toxicity
from railyard.llm.common import unused

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HELPERS = ("_score", "_digest", "_keep_id", "_keep_digest", "_text_key", "_id", "_key", "_copies", "_AT", "_of", "_target",
           "_copy", "_score_")


def test_special_tokens_are_what_the_library_makes_of_them(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z\n<|endoftext|> <|endoftext|>w", "<|endoftext |>", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = token_store.read_tokens(token_store.write_tokens(docs, queries.TOKENIZER)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = array("I", [*tok.encode(t or "", add_special_tokens=False).ids, 0]).tobytes()
        assert (r.n_tokens, r.ids_crc32) == (len(ids) // 4, zlib.crc32(ids))
    assert got[0].n_tokens == 5


def test_equal_ids_spread_over_files(spark):
    rows = [(7, f"text number {i}") for i in range(400)] + [(None, "n")] * 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.TOKENIZER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.select("shard").distinct().count() > 1
    starts = sorted((r.start, r.n_tokens) for r in token_store.read_tokens(got).collect())
    assert len(starts) == 403 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def _labelled(spark, n_toxic, n_clean):
    rng = np.random.default_rng(0)
    words = ["river", "stone", "green", "paper", "window", "music", "garden", "letter"]
    rows, labels = [], []
    for i in range(n_toxic + n_clean):
        text = list(rng.choice(words, 40))
        if i < n_toxic:
            for at in rng.choice(40, 6, replace=False):
                text[at] = rng.choice(["you", "idiot", "scum", "worthless"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i < n_toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_rare_labels_still_fit_trees(spark):
    docs, labels = _labelled(spark, 60, 1500)
    model = toxicity.fit(docs, labels, F.lit(True), max_rows=400)  # a plain sample would hold about 15
    assert model.trees is not None
    got = toxicity.score_documents(docs, labels, max_rows=400).toPandas()
    toxic = got.doc_id < 60
    assert (got[toxic].predicted == 1).mean() > 0.95 and (got[~toxic].predicted == 0).mean() > 0.99
    # the calibration restores the full table's share: 60 of 1,560, not the sample's
    assert abs(got.score.mean() - 60 / 1560) < 0.02


def test_below_the_floor_the_general_list_decides(spark):
    docs, labels = _labelled(spark, 20, 100)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.trees is None
    x = model.score(["you idiot", "nothing here"], toxicity.WordCodes(model.lexicon))
    assert x[0] > 0.5 and x[1] == 0


def test_weighted_isotonic_is_a_weighted_mean():
    xs, ys = toxicity.isotonic(np.array([0.0, 0.0, 1.0]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 3.0, 1.0]))
    assert np.allclose(np.interp([0.0, 1.0], xs, ys), [0.25, 1.0])


def test_unused_names(spark):
    df = spark.createDataFrame([], "_a long, _A_ long, b long")
    assert unused(df, "_a", "_b", "_a") == ["_a__", "_b", "_a___"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some words of text number {i // 2} and a few more", "en", f"s{i % 2}", 9, *["kept"] * len(HELPERS))
            for i in range(12)]
    return spark.createDataFrame(rows, DOCS + "".join(f", {h} string" for h in HELPERS))


@pytest.mark.parametrize("stage", ["toxic", "copies", "near", "mix"])
def test_helper_columns_do_not_clash(spark, clashing, stage):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = {"toxic": lambda: toxicity.drop_toxic(clashing, labels), "copies": lambda: dedup_tree.drop_copies(clashing),
           "near": lambda: ngram_join.drop_near_copies(clashing), "mix": lambda: curriculum.drawn(clashing)}[stage]()
    assert got.columns == clashing.columns
    rows = got.collect()
    assert len(rows) >= 6 and all(r[h] == "kept" for r in rows for h in HELPERS)


def test_stages_of_odd_tables(spark):
    """Null ids and empty tables through every stage."""
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(None, "a b c d e f g", None, None, None), (None, None, None, None, None),
                                 (3, "", "en", "s", 0), (4, "a b c d e f g", "en", "s", 1)], DOCS)
    for docs, n in ((odd, 2), (odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf), "test-stage")
        assert docs.count() >= n


def test_token_store_codes_lanes_together():
    """op2: the lanes of a block learn from one another, blocks decode by themselves, and a step costs
    the same few calls whatever the number of lanes."""
    rng = np.random.default_rng(8)
    ids = rng.choice(rng.integers(0, 65536, 300), 400_000, p=rng.dirichlet(np.ones(300)))
    frame = token_store.encode_ids(ids, block=32)  # several blocks, the last one short
    assert token_store.decode_ids(frame).tolist() == ids.tolist()
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(token_store.encode_ids(ids)) * 8 / len(ids) < entropy + 1.5
    for at in rng.integers(24, len(frame), 12).tolist():
        bad = bytearray(frame)
        bad[at] ^= 1 << int(rng.integers(8))
        with pytest.raises(ValueError):
            token_store.decode_ids(bytes(bad))


def test_token_store_ids_are_those_of_the_library():
    """op2: chunks cut by Arrow and encoded together give the library's ids, also once some are forgotten."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer
    tok, rng = Tokenizer.from_file(queries.TOKENIZER), random.Random(3)
    parts = [" ", "\n", "  ", "a", "word", "Wort,", "y?", ".", "don't", "é", "ж", "1", "22", "\t", "\r", "\x85", "\xa0",
             "　", "<|endoftext|>", "!!", "'s", "\x1c", "😀", "İ", "".join(rng.choices("abcdefgh", k=9))]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(6000)]
    texts += [" ".join("".join(rng.choices("abcdé.", k=rng.randint(1, 7))) for _ in range(6)) for _ in range(2000)]
    for limit in (600_000, 3_000):
        cache = token_store._TextIds(queries.TOKENIZER, limit)
        for i in range(0, len(texts), 500):
            ids, count = cache.many(pa.array([*texts[i:i + 500], None]).slice(3))
            want = tok.encode_batch([*texts[i + 3:i + 500], ""], add_special_tokens=False)
            assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in want]

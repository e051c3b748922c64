"""Spelling groups, Merkle manifest and quality model against plain versions,
with null, empty, long, tied and repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from railyard.llm import merkle_manifest, quality_gam, queries, spelling_groups

TINY = "/root/testdata/sf0.001"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, word string, n long, leaf string, "
        "node string, tree long, proof string, score double, quality int, _id long, _text string")
_LONG = " ".join(f"w{i % 977}" for i in range(30_000))
_MORE = ("x", 1, "y", "z", 2, "p", 0.5, 1, 7, "t")
EDGE = [(r + _MORE) for r in [
    (3, "Ab  b\tc", "en", "s", 1), (1, "a B c", "en", "s", 1), (1, "a B c", "en", "s", 1), (None, "a b c", None, None, None),
    (None, None, None, None, None), (7, "", "", "t", 0), (8, " ", "en", "t", 0), (9, _LONG, "de", "u", 1),
    (9, "Other text under the same id", "de", "u", 1), (10, _LONG + " Tail", "de", "\U0001F600", 1),
    (11, "é" * 70_000 + " naïve naïve", "fr", "s", 1), (-5, "MINUS", "en", "s", 1)]]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ spelling
def spelling_brute(rows, least=6, occurrences=5, every=199, ratio=5):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            seen[word] += 1
    n = {w: c for w, c in seen.items() if len(w) >= least and c >= occurrences}
    near = {w: [v for v in n if v != w and _one_apart(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_spelling_groups_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words = [w for w in base for _ in range(rng.choice((1, 5, 30, 200)))]
    for w in base * 12:
        i = rng.randrange(len(w) + 1)
        words.append(rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice("abÉÿ") + w[i + 1:], w[:i] + "b" + w[i:], w.upper())))
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::50])) for i in range(50)] + [(None, "abcabc " * 7), (5, None), (6, "")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = spelling_rows(spelling_groups.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"),
                                                            every=7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = spelling_brute(rows, every=7)
    assert len(want) > 30 and sum(v[0] is not None for v in want.values()) > 5
    assert got == want


def test_runs_of_one_letter_count_once(spark):
    rows = [(i, w) for w, k in (("aaaaaa", 50), ("aaaaaaa", 9), ("baaaaa", 8), ("aaaaaab", 5)) for i in range(k)]
    got = spelling_rows(spelling_groups.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"),
                                                        every=10**9))
    assert got == spelling_brute(rows, every=10**9)
    assert got["aaaaaa"][3] == 3


def test_chains_of_forms_reach_the_last(spark):
    chain = ["zzzzzz", "zzzzzy", "zzzzyy", "zzzyyy", "zzyyyy"]
    rows = [(i, " ".join([w] * 5 ** (5 - k))) for i, (k, w) in enumerate(enumerate(chain))]
    got = spelling_rows(spelling_groups.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"),
                                                        every=10**9))
    assert got["zzyyyy"][:2] == ("zzzyyy", "zzzzzz") and got == spelling_brute(rows, every=10**9)


def test_typos_over_arrays_equal_single_sums():
    counter = spelling_groups.TypoCounter(3, 1)
    text = "Häuser sind groß AND kleine x " * 50 + "ÿ" * 300
    counter.add("12", text)
    got = dict(zip(*counter.counts().to_pydict().values()))
    want = Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text):
        w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
        h = zlib.crc32(f"12:{w}".encode())
        want[w if h % 3 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    want.pop("", None)
    assert got == want


def test_flushes_and_pieces_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling_groups, "_PIECE", 50)
    assert [w for p in spelling_groups.pieces("ab cd " * 100) for w in p] == [b"ab", b"cd"] * 100
    assert [w for p in spelling_groups.pieces("x" * 333) for w in p] == [b"x" * 333]
    counter, total = spelling_groups.TypoCounter(199, 1), Counter()
    for i in range(40):
        counter.add(str(i), "one two three " * 9)
        if i % 7 == 0:
            total.update(dict(zip(*counter.counts().to_pydict().values())))
    total.update(dict(zip(*counter.counts().to_pydict().values())))
    assert sum(total.values()) == 40 * 27


def test_spelling_edge(edge, none):
    got = spelling_rows(spelling_groups.spelling_groups(edge))
    assert got == spelling_brute([(r[0], r[1]) for r in EDGE])
    assert spelling_groups.spelling_groups(none).count() == 0


# ------------------------------------------------------------------ Merkle
def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h("".join(below[i:i + 8])) for i in range(0, len(below), 8)])
    return levels


def _path(levels, i):
    out = []
    for below in levels[:-1]:
        a = i // 8 * 8
        run = below[a:a + 8]
        out.append((i - a, run[:i - a] + run[i - a + 1:]))
        i //= 8
    return out


def merkle_brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    if not order:
        return []
    members = [sorted(groups[g], key=lambda x: x[:3]) for g in order]
    trees = [_tree([m[2] for m in ms]) for ms in members]
    top = _tree([t[-1][0] for t in trees])
    out = []
    for g, (ms, tree) in enumerate(zip(members, trees)):
        for i, (_, _, leaf, r) in enumerate(ms):
            path = _path(tree, i) + _path(top, g)
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = _leaf(*r[:4], re.sub("[A-Z]", lambda m: m.group().lower(), r[4]))
            for slot, others in path:
                h = _h("".join(others[:slot]) + h + "".join(others[slot:]))
            out.append((r[0], leaf, tree[-1][0], top[-1][0], _h("".join("".join(o) for _, o in path)), h, h == top[-1][0]))
    return out


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merkle_edge_and_empty(edge, none):
    want = merkle_brute([(r[0], r[3], r[2], r[4], r[1]) for r in EDGE])
    got = merkle_manifest.tamper_report(edge)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _rows(got) == sorted(want, key=repr)
    assert merkle_manifest.tamper_report(none).count() == 0


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1, 1], [64, 65, 1], [513, 7], [1] * 70 + [600]])
def test_merkle_trees_of_all_heights(spark, sizes):
    rows = [(1000 * g + 3 * i, "s", None if g == 1 else f"l{g:03}", i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _rows(merkle_manifest.tamper_report(df)) == sorted(merkle_brute(rows), key=repr)


def test_merkle_without_broadcasts(spark, monkeypatch):
    """Lookups beyond the bound meet by shuffle, large trees still by broadcast."""
    monkeypatch.setattr(merkle_manifest, "FEW", 2)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 4)
    rows = [(i, "s", f"l{i % 9 if i < 300 else 4}", i, f"Text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _rows(merkle_manifest.tamper_report(df)) == sorted(merkle_brute(rows), key=repr)


def test_proofs_have_their_own_interface(spark):
    rows = [(i, i % 2, f"payload {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "key long, part long, body string")
    leaves = df.select("key", "part", "body", merkle_manifest.leaf_digest("key", "body").alias("leaf"))
    got = merkle_manifest.proofs(leaves, "part", "key", ("body",))
    assert got.columns == ["key", "body", "leaf", "subroot", "root", "proof"]
    odd = leaves.withColumnsRenamed({"key": "node", "body": "tree"}).withColumn("nth", F.lit(1)).withColumn("segs", F.lit(2))
    again = merkle_manifest.proofs(odd, "part", "node", ("tree", "nth", "segs"))
    assert again.columns == ["node", "tree", "nth", "segs", "leaf", "subroot", "root", "proof"]
    assert {r.root for r in again.collect()} == {r.root for r in got.collect()}
    assert got.filter(merkle_manifest.folded("leaf") == F.lower(F.hex("root"))).count() == 30
    assert got.filter(F.size("proof") == 3).count() == 30  # 15 leaves: two levels, and one above


# ------------------------------------------------------------------ quality
def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_gam.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    assert (got.held_out == held).all()
    out = got[held]
    assert ((out.predicted == 1) == (out.score >= 0.5)).all() and out.score.between(0, 1).all()
    assert (out[out.quality == 1].predicted == 1).mean() >= 0.99
    assert (out[out.quality == 0].predicted == 0).mean() >= 0.95
    rank = out.score.rank()
    good, bad = (out.quality == 1).sum(), (out.quality == 0).sum()
    assert (rank[out.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) >= 0.995


def test_quality_never_reads_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_gam.score_documents(docs, lab).orderBy("doc_id").toPandas() for lab in (labels, flipped))
    assert a.equals(b)


def test_quality_edge(spark, edge, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(-5, 12)] + [(None, 1, "x"), (3, None, "x"), (4, 9, "x")],
                                   "doc_id long, quality int, score string")
    got = quality_gam.score_documents(edge, labels, rounds=3)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == len(EDGE) and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality_gam.score_documents(none, labels, rounds=3).count() == 0
    one_kind = quality_gam.score_documents(edge, labels.filter("quality = 1")).collect()
    assert {r.predicted for r in one_kind} == {1}
    assert {r.score for r in quality_gam.score_documents(edge, labels.limit(0)).collect()} == {0.5}


def test_gam_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no feature alone tells anything
    m = quality_gam.PairwiseGam(rounds=20, pair_rounds=60, pairs=2).fit(x, y, np.ones(len(y)))
    assert (0, 1) in m.pair_tables
    fresh = rng.normal(size=(500, 4))
    want = (fresh[:, 0] > 0) ^ (fresh[:, 1] > 0)
    assert ((m.margin(fresh) > 0) == want).mean() > 0.9
    plain = np.full(500, m.base)
    for i, row in enumerate(fresh):
        for j, t in enumerate(m.tables):
            plain[i] += t[np.searchsorted(m.edges[j], row[j], "right")]
        for (a, b), t in m.pair_tables.items():
            plain[i] += t[np.searchsorted(m.pair_edges[a], row[a], "right"), np.searchsorted(m.pair_edges[b], row[b], "right")]
    assert np.allclose(plain, m.margin(fresh))


def test_weights_restore_the_shares():
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.5).astype(float)
    m = quality_gam.PairwiseGam(rounds=5, pair_rounds=0).fit(np.zeros((2000, 1)), y, np.where(y == 1, 9.0, 1.0))
    assert abs(1 / (1 + np.exp(-m.margin(np.zeros((1, 1)))[0])) - 9 * y.sum() / (9 * y.sum() + (1 - y).sum())) < 1e-6


def test_stretches_cover_all_words(monkeypatch):
    monkeypatch.setattr(quality_gam, "_WORDS", 16)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 200)))
        assert [w for s in quality_gam._stretches(text) for w in s] == text.split()


@pytest.mark.parametrize("name", ["op11_spelling_groups", "op12_merkle_manifest", "op13_quality_gam"])
def test_queries_run_on_whole_tables(spark, name):
    import sys
    sys.path.insert(0, "tests")
    import oracle_harness
    sql = queries.oracle_sql().get(name)
    if sql:
        ok, msg = oracle_harness.compare(spark, name, queries.queries()[name], sql, TINY)
        assert ok, msg
    else:
        assert queries.queries()[name](spark, TINY).count() == spark.read.parquet(f"{TINY}/documents.parquet").count()

"""The dealt operators against brute force, exact round trips and edge cases.

EDGE holds null and empty texts, null and repeated ids, repeated rows, ties, a
long text, and extra columns whose names clash with those of results.
"""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from railyard.llm import (chat_mask, crosspoly_ann, curriculum, dedup_tree, ngram_join, pii_tagger, queries,
                          secret_scan, spm_bpe, token_store, toxicity)
from railyard.llm.common import ChunkCache, components

TINY = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size string"
_LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EDGE = [(3, "a  b\tc", "en", "s", 1, 9, "x"), (1, "a b c", "en", "s", 1, 9, "x"), (1, "a b c", "en", "s", 1, 9, "x"),
        (None, "a b c", None, None, None, None, None), (None, None, None, None, None, None, None), (7, "", "en", "t", 0, 1, "y"),
        (8, " ", "en", "t", 0, 1, "y"), (9, _LONG, "de", "u", 1, 1, "z"), (9, "other text under the same id here", "de", "u", 1, 1, "z"),
        (10, _LONG + " tail", "de", "\U0001F600", 1, 1, "z"), (11, "mail x@y.com token=abcdefgh12 é", "fr", "s", 1, 1, "z")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ op1
def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_nearest_recall_and_ranks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype("float32")
    x[5] = x[700] = x[3]  # ties go to the smaller id
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    got = crosspoly_ann.nearest(_vectors(spark, rows), F.col("id") % 50 == 3, piece=100, hashes=1).toPandas()
    y, hit, total = x.astype(float), 0, 0
    for q in range(3, 1500, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        assert np.allclose(mine.score, d[mine.vec_id], rtol=1e-12)
        assert list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        hit, total = hit + len(set(want) & set(mine.vec_id)), total + 10
    assert hit / total >= 0.9
    assert list(got[got.query_id == 3].sort_values("rank").vec_id[:2]) == [5, 700]


def test_nearest_edge_vectors(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [float("nan"), 1.0], "x"),
            (5, [None, 1.0], "x"), (6, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x"), (7, [float("inf"), 0.0], "x"),
            (8, [2.0, 0.0], "x"), (8, [2.0, 0.0], "x")]
    got = crosspoly_ann.nearest(_vectors(spark, rows), F.lit(True), probes=4).toPandas()
    assert set(got.query_id) == {0, 1, 8} and set(got.vec_id) == {0, 1, 8}
    assert got[(got.query_id == 0) & (got["rank"] == 1)].iloc[0].vec_id == 8
    assert crosspoly_ann.nearest(_vectors(spark, []), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [1, 9, 10, 11, 12, 40, 200, 300, 2048])
def test_meet_group_equals_a_full_sort(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24))
    q = np.concatenate([rng.normal(size=(3000, 24)), x[:50]])  # own ids are left out
    qid = np.concatenate([np.arange(10_000, 13_000), np.arange(min(n, 50))])

    def table(ids, v):
        return pa.table({"id": pa.array(ids, pa.int64()), "v": pa.array(list(v), pa.list_(pa.float64()))})

    order = rng.permutation(n)
    got = crosspoly_ann.meet_group(table(order, x[order]), table(qid, q), 10).to_pandas()
    mine = {i: list(g.vec_id) for i, g in got.groupby("query_id")}
    for i, v in zip(qid, q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        assert mine.get(i, []) == [j for j in np.lexsort((np.arange(n), d)) if j != i][:10]


def test_recall_does_not_fall_with_size(spark):
    """140,000 rows of 8 dimensions with one probe: a size that once switched to two hashes."""
    x = np.random.default_rng(0).normal(size=(140_000, 8))
    flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 8, dtype=np.int32), x.reshape(-1))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": flat}))
    got = crosspoly_ann.nearest(df, F.col("id") < 200, probes=1).toPandas()
    hit = 0
    for q in range(200):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hit / 2_000 >= 0.97


def test_two_hashes_probe_distinct_buckets():
    signs = crosspoly_ann.hadamard_signs(3, 2, 16, 1)
    x = np.random.default_rng(0).normal(size=(20, 13))
    probes = crosspoly_ann.probe_buckets(x, signs, 12)
    assert (probes[:, :, 0] == crosspoly_ann.axis_buckets(x, signs)).all()
    assert all(len(set(p)) == 12 for row in probes for p in row)
    assert np.allclose(np.linalg.norm(crosspoly_ann.pseudo_rotate(x, signs[0, 0]), axis=1), np.linalg.norm(x, axis=1))


# ------------------------------------------------------------------ op2
@pytest.mark.parametrize("ids", [[], [7], [65535] * 3000, list(range(200)) * 9,
                                 np.random.default_rng(2).integers(0, 65536, 7001).tolist()])
def test_range_coder_round_trip(ids):
    frame = token_store.encode_ids(np.array(ids, "u4"), block=256)
    assert token_store.decode_ids(frame).tolist() == list(ids)


def test_range_coder_blocks_are_checked():
    frame = bytearray(token_store.encode_ids(np.arange(5000) % 700))
    frame[-20] ^= 1
    with pytest.raises(ValueError):
        token_store.decode_ids(bytes(frame))
    with pytest.raises(ValueError):
        token_store.encode_ids(np.array([70000]))


def _ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [array("I", e.ids).tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_store_query(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()}
    start = 0
    for r in queries.op2_token_store(spark, TINY).orderBy("doc_id").collect():
        ids = _ids([docs[r.doc_id]])[0] + bytes(4)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_token_store_edges(spark, edge, none):
    got = token_store.read_tokens(token_store.write_tokens(edge, queries.TOKENIZER, frame_ids=1000)).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(_ids([t or ""])[0]) // 4 + 1 for _, t, *_ in EDGE)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert token_store.read_tokens(token_store.write_tokens(none, queries.TOKENIZER)).count() == 0


# ------------------------------------------------------------------ op3
def test_exact_dedup_edges(edge, none):
    rows = dedup_tree.exact_dedup(edge, runs=8, fan_in=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(rows) == len(EDGE)
    abc = by[hashlib.sha256(b"a b c").hexdigest()]
    assert [r.group_size for r in abc] == [4] * 4 and {r.keep_id for r in abc} == {1}
    assert sum(r.kept for r in abc) == 1 and next(r for r in abc if r.kept).doc_id == 1
    assert by[hashlib.sha256(b"").hexdigest()][0].keep_id == 7
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert dedup_tree.exact_dedup(none).count() == 0
    kept = dedup_tree.drop_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(by)


# ------------------------------------------------------------------ op4
def _brute(rows, k, num):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(doc), len(s), str(least.get(find(i)))) for i, (doc, s) in enumerate(sets))


def _found(df, k, num):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                  for r in ngram_join.jaccard_components(df, k=k, num=num).collect())


@pytest.mark.parametrize("piece", [1_000_000, 300])
def test_ngram_join_families(spark, monkeypatch, piece):
    monkeypatch.setattr(ngram_join, "PIECE_TOKENS", piece)
    rng = random.Random(4)
    rows = []
    for family in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 12, 40, 90, 150]))]
        for _ in range(rng.choice([1, 2, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w) if rng.random() < 0.8 else "\n".join(w).upper()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(df, 4, 85) == _brute(rows, 4, 85)
    assert _found(df, 5, 80) == _brute(rows, 5, 80)


def test_ngram_join_edges(edge, none):
    assert _found(edge, 4, 85) == _brute([r[:2] for r in EDGE], 4, 85)
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "None", "7", "8", "9", "9", "11"])


def test_components_of_a_long_path(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    got = components(links).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


# ------------------------------------------------------------------ op5
_BASE = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = ["1", "22", "@", ".", "-", " ", "a", "b.c", "+", "(", "4111111111111111", "255", "é", "x@y.z"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = sorted((m.start(), k, m.end()) for k, p in _BASE.items() for m in re.finditer(p, text)
                      if pii_tagger.plausible(pii_tagger.KINDS[k], m[0]))
        assert pii_tagger.base_spans(text) == want
    assert pii_tagger.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_tagger_gradient():
    rng = np.random.default_rng(0)
    t = pii_tagger.Tagger(4, 3)
    x, y = rng.integers(0, pii_tagger.CODES, (3, 7)), rng.integers(0, pii_tagger.TAGS, (3, 7))
    _, grad = t.gradient(x, y)
    for name, value in t.p.items():
        at = (x[0, 0], 1) if name == "emb" else tuple(rng.integers(0, n) for n in value.shape)
        old, loss = value[at], []
        for e in (1e-5, -1e-5):
            value[at] = old + e
            loss.append(t.gradient(x, y)[0])
        value[at] = old
        assert abs(grad[name][at] - (loss[0] - loss[1]) / 2e-5) < 1e-6


def test_personal_data(spark, edge, none):
    out = {(r.doc_id, r.spans) for r in pii_tagger.find_personal_data(edge, max_windows=50).collect()}
    assert (11, "email:5:12") in out and (None, "") in out and len(out) == len({(r[0], r[1] == EDGE[-1][1]) for r in EDGE})
    assert pii_tagger.find_personal_data(none, max_windows=50).count() == 0


def test_tagger_learns_looser_spellings(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    codes, tags = pii_tagger.labelled_windows(docs, "doc_id", "text", 200, 300)
    cut = len(codes) * 4 // 5
    order = np.random.default_rng(0).permutation(len(codes))
    tagger = pii_tagger.Tagger().fit(codes[order[:cut]], tags[order[:cut]], epochs=10)
    held = order[cut:]
    on = tags[held] > 0
    assert (tagger.decode(codes[held]) == tags[held])[on].mean() > 0.8


# ------------------------------------------------------------------ op6
def _secrets(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                    for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def _entropy_span(hit, start, w=secret_scan.WINDOW):
    hot = []
    for i in range(len(hit) - w + 1):
        part = hit[i:i + w]
        counts = np.array([part.count(c) for c in set(part)])
        h = np.log2(w) - (counts * np.log2(counts)).sum() / w
        digit, lower, upper = (any(f(c) for c in part if c.isascii()) for f in (str.isdigit, str.islower, str.isupper))
        if (re.fullmatch("[0-9a-f]+", part) and digit and lower and h >= 3.0) or (digit and lower and upper and h >= 3.75):
            hot.append(i)
    return (start + hot[0], start + hot[-1] + w) if hot else None


def test_secret_scan(spark, none):
    rng = random.Random(3)
    parts = ["password", "Token", "=", ": ", '"', " ", "abc12345", "AKIA", "ABCDEFGH2345", "0123456789abcdef" * 2, "é", "😀", "x", "api_key:"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)] + [(5, "password=abcdefgh9"), (5, "password=abcdefgh9"), (None, None)]
    got = secret_scan.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda d, h: (str(d), h)
    want = sorted(key(d, hashlib.sha256(_secrets(t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted(key(r.doc_id, r.base_sha256) for r in got) == want
    assert secret_scan.secret_report(none).count() == 0


def test_entropy_windows_match_direct_counts(spark):
    rng = random.Random(8)
    al = "abcdefABCDEF0123456789xyzXYZ+/"
    hits = [(i, i * 7, 3 * i, "".join(rng.choices(al[:rng.choice([6, 14, 30])], k=rng.randint(20, 60)))) for i in range(120)]
    df = spark.createDataFrame(hits, "id long, key long, start int, hit string")
    got = {r.id: (r.start, r.finish) for r in secret_scan.entropy_spans(df).collect()}
    assert got == {i: s for i, _, at, h in hits if (s := _entropy_span(h, at))}


@pytest.mark.parametrize("alphabet, n", [("0123456789ABCDEF", 40), ("abcdefghijklmnopqrstuvwxyz0123456789", 40),
                                         ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32)])
def test_entropy_finds_each_class(spark, alphabet, n):
    rng = random.Random(11)
    rows = [(i, f"see {''.join(rng.choices(alphabet, k=n))} here") for i in range(200)]
    rows.append((200, "see internationalisation2internationalisation here"))
    rows.append((201, "see ORDERORDERORDER0001ORDER here"))
    got = {r.doc_id: r.n_entropy for r in secret_scan.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(200)) >= 190 and got[200] == got[201] == 0


def test_allowed_strings_are_left_alone(spark):
    rows = [(1, "see 123e4567-e89b-12d3-a456-426614174000 ok"), (2, "id Zx81kQpT0vRb7LmN4wYc done"), (3, "thisIsAnExampleKey9Zx81kQpT0vRb7")]
    got = {r.doc_id: r.spans for r in secret_scan.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "entropy:3:23", 3: ""}


# ------------------------------------------------------------------ op7
def test_chat_masks_round_trip():
    rng, tok = random.Random(1), chat_mask._tokenizer(queries.TOKENIZER)
    parts = ["a", "</s>", "[INST]", " [/INST]", " ", "\n", "\\", "é", "日", "😀", "<s>", "\\l", "x "]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "a\nb<"]), "".join(rng.choices(parts, k=rng.randint(0, 8))))
                 for _ in range(rng.randint(0, 5))]
        text, spans = chat_mask.render(turns)
        assert chat_mask.parse(text) == turns
        offsets = np.asarray(tok.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        mask, a, b = chat_mask.token_mask(offsets, spans)
        assert [text[i:j] for i, j in zip(a, b)] and "".join(text[i:j] for i, j in zip(a, b)) == "".join(text[i:j] for i, j in spans) \
            if spans else not mask.any()
        assert mask.tolist() == [any(s < y and x < e for s, e in spans) for x, y in offsets]


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op7_chat_masks(spark, TINY).collect()}
    given = {}
    for r in spark.read.parquet(f"{TINY}/conversations.parquet").orderBy("conv_id", "turn").collect():
        given.setdefault(r.conv_id, []).append((r.role, r.text))
    given[-7] = [r[2:] for r in queries.ODD_CONVERSATION]
    assert set(got) == set(given)
    for conv, turns in given.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "b", "x"), (None, None, "assistant", "c", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r.n_turns for r in chat_mask.read_back(chat_mask.format_conversations(df, queries.TOKENIZER)).collect()}
    assert got == {1: 3, None: 1}
    assert chat_mask.format_conversations(df.limit(0), queries.TOKENIZER).count() == 0


# ------------------------------------------------------------------ op8
def _reshared(sizes, weights, total):
    out, left, open_ = [0.0] * len(sizes), total, {i for i in range(len(sizes))}
    while left > 1e-9 and open_:
        w = sum(weights[i] for i in open_)
        add, left = {i: left * weights[i] / w for i in open_}, 0.0
        for i, a in add.items():
            out[i] += a
            if out[i] >= 2 * sizes[i]:
                left += out[i] - 2 * sizes[i]
                out[i] = 2 * sizes[i]
                open_.discard(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix_targets_and_shares(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "é", "\U0001F600", "z", "B"][: 4 + seed]
    rows = [(i, " ".join("w" * rng.choice([0, 1, 5, 40, 900 * (rng.random() < 0.05)]).__int__()), rng.choice(names) if rng.random() < 0.6 else "a")
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = curriculum.curriculum_mix(df, rows_per_bucket=50).join(df, "doc_id").toPandas()
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(t.split()) for _, t, s in rows if s == o) for o in order]
    want = _reshared(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes))
    for o, size, target in zip(order, sizes, want):
        mine = got[got.source.isnull()] if o is None else got[got.source == o]
        assert set(mine.source_size) == {size} and abs(mine.target.iloc[0] - target) < 1e-6
        assert abs(mine.taken.sum() - target) <= 0.51
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    assert got.position.dropna().between(0, 1).all()


def test_mix_edges(edge, none):
    got = curriculum.curriculum_mix(edge)
    assert got.count() == len(EDGE) and curriculum.curriculum_mix(none).count() == 0
    drawn = curriculum.drawn(edge)
    assert drawn.columns == edge.columns and drawn.count() > 0 and curriculum.drawn(none).count() == 0


# ------------------------------------------------------------------ op9
def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.01 * (got.toxic == 0).sum()
    assert ((got.predicted == 1) & (got.toxic == 1)).sum() >= 0.9 * (got.toxic == 1).sum()
    assert got.score.between(0, 1).all()


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(edge, labels)
    assert got.count() == len(EDGE) and got.filter("score is null or held_out is null").count() == 0
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.drop_toxic(edge, labels).columns == edge.columns


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.normal(size=300)
    x, y = toxicity.isotonic(s, (rng.random(300) < 1 / (1 + np.exp(-s))).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) > -1e-12).all() and 0 <= y.min() <= y.max() <= 1


# ------------------------------------------------------------------ op10
ODD = ["", " ", "  a  b", "a\n\nb\t c \r\n", "日本語 テスト ", "x" * 300 + " " * 50 + "y", "a b  c", "😀😀 café's don't I'LL 12 ½",
       "\n", "\n\na", "a ", "<|endoftext|>", "a.,b ,. c.", "\x1c a\x85b", "é l'été"]


def test_spm_bpe_equals_tiktoken(spark):
    import tiktoken
    bpe = spm_bpe.SpmByteBpe(queries.RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = ODD + [r[0] for r in spark.read.parquet(f"{TINY}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_spm_bpe_edges(edge, none):
    got = spm_bpe.encode_documents(edge, queries.RANKS, P.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in EDGE)
    assert spm_bpe.encode_documents(none, queries.RANKS, P.PATTERN, keep_ids=True).count() == 0


def test_chunks_rejoin():
    cache = ChunkCache(lambda new: [c.encode() for c in new], limit=3)
    assert cache.many(ODD) == [t.encode() for t in ODD] == cache.many(ODD)


# ------------------------------------------------------------------ pipeline
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C
    from railyard.llm.common import documents, written
    import tiktoken
    docs, kept = documents(spark, TINY), []
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, TINY), "test-stage")
        kept.append(docs)
    assert all(k.columns == documents(spark, TINY).columns for k in kept[:-1])
    clean = {r.doc_id: r.text for r in kept[0].collect()}
    first = {}
    for d in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", clean[d]), d)
    assert {r.doc_id for r in kept[1].collect()} == set(first.values())
    groups = _brute([(d, clean[d]) for d in sorted(first.values())], 5, 80)
    assert {str(r.doc_id) for r in kept[2].collect()} == {c for _, _, c in groups}
    mixed = [r.doc_id for r in kept[3].collect()]
    assert set(mixed) <= {r.doc_id for r in kept[2].collect()} and max(map(mixed.count, mixed)) <= 2
    bpe = spm_bpe.read_ranks(queries.RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe, special_tokens={})
    rows = kept[4].collect()
    assert sorted(r.doc_id for r in rows) == sorted(mixed)
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(clean[r.doc_id])

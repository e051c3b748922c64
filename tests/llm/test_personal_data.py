"""What the trained tagger adds, on spellings that are not among its made-up ones,
and the base columns of the whole query against a plain version."""

import hashlib
import pickle
import random
import re
import time

import numpy as np
import pytest

from railyard.llm import pii_tagger as P
from railyard.llm import queries

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def tagger(documents):
    codes, tags = P.labelled_windows(documents, "doc_id", "text", 2000, 2500)
    return P.Tagger().fit(codes, tags)


def _digits(rng, n):
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng):
    return "".join(rng.choice(list("abcdefghilmnoprstuvw"), rng.integers(3, 9)))


def _card(rng, sep):
    while True:
        d = _digits(rng, 16)
        if P.luhn(d):
            return sep.join(d[i:i + 4] for i in range(0, 16, 4))


SPELLINGS = {
    "email (at) (dot)": (0, lambda r: f"{_word(r)}-{_word(r)} (at) {_word(r)} (dot) org"),
    "email arroba punto": (0, lambda r: f"{_word(r)} arroba {_word(r)} punto es"),
    "email blanks": (0, lambda r: f"{_word(r)}.{_word(r)} @ {_word(r)} . com"),
    "ip blank before": (1, lambda r: " .".join(str(x) for x in r.integers(0, 256, 4))),
    "ip blank behind": (1, lambda r: ". ".join(str(x) for x in r.integers(0, 256, 4))),
    "card points": (2, lambda r: _card(r, ".")),
    "card double hyphens": (2, lambda r: _card(r, "--")),
    "phone without lead": (3, lambda r: f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}"),
    "phone 00": (3, lambda r: f"00{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 6)}"),
}


@pytest.mark.parametrize("name", SPELLINGS)
def test_model_finds_other_spellings(documents, tagger, name):
    kind, make = SPELLINGS[name]
    rng = np.random.default_rng(99)
    plain = [re.sub("[0-9@+]", "", r.text)[:120] for r in documents.select("text").limit(60).collect()]
    hit = total = 0
    for i in range(60):
        value = make(rng)
        text = f"{plain[i]} {value} {plain[i * 7 % 60]}"
        a = len(plain[i]) + 1
        own = P.base_spans(text)
        if any(s < a + len(value) and e > a for s, _, e in own):
            continue  # the base rules have it
        total += 1
        hit += (a, kind, a + len(value)) in P.added(text, own, P.tag_texts(tagger, [text])[0])
    assert total >= 20 and hit / total >= 0.8


def test_model_leaves_clean_text_alone(documents, tagger):
    clean = [re.sub("[0-9@+]", "", r.text) for r in documents.select("text").collect()]
    clean += ["look at this and that, dot your letters", "on 2024-01-15 10 30 we met", "item 12 of 40, page 7", "1 2 3 4 5 6 7 8 9 10"]
    found = [P.added(t, P.base_spans(t), m) for t, m in zip(clean, P.tag_texts(tagger, clean))]
    assert sum(map(len, found)) == 0


def test_acceptance_and_snapping():
    assert P.accepted("a.b (at) c (dot) org", 0) and P.accepted("a at b dot com", 0) and not P.accepted("word. a at b dot com", 0)
    assert P.accepted("555-123-4567", 3) and not P.accepted("2024-01-15 10 30", 3) and not P.accepted("123456789", 3)
    assert not P.accepted("10.20.30.40", 3) and P.accepted("10 . 20 . 30 . 40", 1)
    text = "call (030) 123.4567 88, now"
    assert P.snapped(text, 7, 3, 18) == (5, 3, 22)
    assert P.snapped("see 4111-1111-1111-1111.", 10, 3, 20) == (4, 2, 23)
    assert P.snapped("nothing here", 0, 0, 7) is None
    assert P.added("555-123-4567", [(0, 2, 5)], [(4, 3, 12)]) == []


def test_windows_reach_spelt_addresses():
    text = "x" * 500 + " jane at mail dot org " + "y" * 500
    assert any(s <= 501 and 521 <= s + P.WINDOW for s in P.window_starts(text))
    assert P.window_starts("no sign of anything, at all") == []


def test_base_columns_of_the_query(spark, documents):
    rows = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    got = queries.op5_personal_data(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                              ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                              ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, rows[r.doc_id]):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                      "card": 12 <= len(d) <= 19 and P.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
                if ok:
                    spans.append((m.start(), P.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
        spans = [s for *_, s in sorted(spans)]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in spans) for k in P.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(spans) <= set(every) and len(every) == len(spans) + r.n_model


def _snapped_plainly(text, a, kind, b):
    """Every pair of edges, the widest first."""
    lo, hi = a, b
    while lo > 0 and a - lo < P.GROWTH and (P._RUNS[kind].match(text[lo - 1]) or text[lo - 1] == " "):
        lo -= 1
    while hi < len(text) and hi - b < P.GROWTH and (P._RUNS[kind].match(text[hi]) or text[hi] == " "):
        hi += 1
    edges = {a, b, lo, hi, *(lo + m.start() for m in P._EDGE.finditer(text[lo:hi]))}
    pairs = [(x, y) for x in edges for y in edges if x < b and y > a and x < y
             and text[x] not in " .,;:" and text[y - 1] not in " .,;:"]
    for x, y in sorted(pairs, key=lambda p: (p[0] - p[1], p)):
        for k in (kind, *((1, 2, 3) if kind else ())):
            if P.accepted(text[x:y], k):
                return x, k, y
    return None


def test_snapping_tries_all_pairs_that_can_be_accepted():
    """op5: the pairs of edges that are left out are none that would be accepted."""
    rng, hits = random.Random(5), 0
    parts = [" ", " ", "\n", " at ", " dot ", "(at)", "at", "DOT", "punto", "arrobat", "@", ".", ". ", " .", "a", "bc", "Jane",
             "mail", "org", "1", "22", "333", "4444", "4111 1111 1111 1111", "+", "(", ")", "-", "--", "00", ",", "é", "İ", "ı",
             "[", "] ", "10.20.30.40", "\t", "\xa0", "K", "po", "ınt", "x.y", "_"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        a = rng.randrange(len(text))
        b, kind = rng.randint(a + 1, len(text)), rng.randrange(4)
        want = _snapped_plainly(text, a, kind, b)
        assert P.snapped(text, a, kind, b) == want, (text, a, kind, b)
        hits += want is not None
    assert hits > 500


@pytest.mark.parametrize("text", ["at " * 7000, "foo bar " * 2500, "at dot " * 3000, "+1 " * 7000, "7 " * 10000])
def test_long_spans_are_snapped_in_time(text):
    """op5: a span of the model over thousands of words took a try, as long as the span, per pair of its edges."""
    begin = time.process_time()
    for kind in range(4):
        P.snapped(text, 0, kind, len(text))
    assert time.process_time() - begin < 10


@pytest.mark.parametrize("text", ["That " * 500, "atst " * 500, "chezs dotty " * 250])
def test_long_spans_of_words_that_hold_a_sign_are_snapped_in_time(text):
    """op5: every "at" within a word counted as a sign, so that each pair of edges was tried: 53 s for one text of 28,537 characters."""
    begin = time.process_time()
    assert P.snapped(text, 0, 0, len(text)) is None
    assert time.process_time() - begin < 1
    # a cut word may still look like a sign
    assert P.snapped("xat b.org", 1, 0, 9) == _snapped_plainly("xat b.org", 1, 0, 9)
    assert P.snapped("That That a at b dot org That", 10, 0, 24) == (10, 0, 24)


def test_scores_of_the_model_are_its_emissions():
    """op5: decoding runs the LSTM as one ONNX model; lines end where they end, and a trained or sent tagger builds its own."""
    rng = np.random.default_rng(4)
    tagger, lengths = P.Tagger(), np.array([40, 40, 17, 1])
    codes = rng.integers(0, P.CODES, (4, 40))
    for model in (tagger, pickle.loads(pickle.dumps(tagger)), tagger.fit(codes, rng.integers(0, P.TAGS, (4, 40)), epochs=2)):
        got = model.scores(codes, lengths)
        for j, n in enumerate(lengths):
            want = model.emissions(codes[j:j + 1, :n])[0][:, 0] - model.p["bias"]
            assert np.abs(got[:n, :, j] - want).max() < 1e-4


def test_decoding_is_viterbi():
    """op5: ways that do not come from O are tried only where one may be the best."""
    rng = np.random.default_rng(6)
    tagger = P.Tagger()
    tagger.p["trans"], tagger.p["first"], tagger.p["bias"] = rng.normal(0, 2, (P.TAGS, P.TAGS)), rng.normal(0, 2, P.TAGS), rng.normal(0, 2, P.TAGS)
    for lead in (0, 2, 6):
        tagger.p["bias"][0] = lead
        lengths = rng.integers(1, 60, 50)
        codes = rng.integers(0, P.CODES, (50, 60))
        got = tagger.decode(codes, lengths)
        for j, n in enumerate(lengths):
            e = tagger.emissions(codes[j:j + 1, :n])[0][:, 0]
            best, ways = e[0] + tagger.p["first"], []
            for x in e[1:]:
                every = best[:, None] + tagger.p["trans"]
                ways.append(every.argmax(0))
                best = every.max(0) + x
            path = [int(best.argmax())]
            for way in reversed(ways):
                path.append(int(way[path[-1]]))
            assert got[j, :n].tolist() == path[::-1]

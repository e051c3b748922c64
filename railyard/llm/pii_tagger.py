"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import merge
from itertools import accumulate, pairwise

import numpy as np
import onnxruntime as ort
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.llm import onnx

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: Window length and step in characters of the training sample, and how far around a
#: digit or @ it reaches.
WINDOW, STEP, REACH = 64, 32, 32
#: Longest stretch that is decoded at once, and how much two stretches of a text share.
SPAN, SHARED = 512, 64

# The patterns of the base rules. Starts are pinned to the start of a run, which
# finds the same leftmost matches without trying every character of long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")
#: The signs of an address written as words, in four languages.
_AT_WORDS, _DOT_WORDS = ("at", "arroba", "chez", "klammeraffe"), ("dot", "punkt", "punto", "point")
_SPELT = re.compile(rf"\b(?:{'|'.join(_AT_WORDS)})\b.{{1,48}}?\b(?:{'|'.join(_DOT_WORDS)})\b", re.I)
_SPELT_AT, _SPELT_DOT = (re.compile(rf"\s*[(\[{{]?\s*\b(?:{'|'.join(w)})\b\s*[)\]}}]?\s*", re.I) for w in (_AT_WORDS, _DOT_WORDS))
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}(?![0-9])")
_GROUPS = re.compile(r"\(?[0-9]{2,5}\)?(?:(?: ?[.-] ?| )[0-9]{2,5}){1,5}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        local = len(_LOCAL.match(text[max(end, at - 1):at][::-1])[0]) if at > end else 0
        if local:
            start = at
            while start > end and _LOCAL.fullmatch(text[start - 1]):
                start -= 1
            if m := _DOMAIN.match(text, at + 1):
                yield start, m.end()
                end = m.end()
        at = text.find("@", max(at + 1, end))


def plausible(kind: str, text: str) -> bool:
    """Whether a match of a kind's pattern is accepted."""
    if kind == "email":
        return True
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if plausible(KINDS[k], m[0])]
    return sorted(out)


def char_codes(text: str) -> np.ndarray:
    """0 padding, 1 other letter, 2 other white space, 3 anything else, 4.. printable ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where((points >= 32) & (points < 127), points.astype(np.int64) - 28, 3)
    rest = np.flatnonzero(out == 3)
    if len(rest):
        signs, which = np.unique(points[rest], return_inverse=True)
        out[rest] = np.array([1 if chr(p).isalpha() else 2 if chr(p).isspace() else 3 for p in signs.tolist()])[which]
    return out


CODES = 99


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, one LSTM per direction, a linear layer, and CRF transitions."""

    def __init__(self, embed: int = 12, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)

        def matrix(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.hidden, self.session = hidden, None
        self.p = {"emb": rng.normal(0, 0.5, (CODES, embed)), "out": matrix(2 * hidden, TAGS), "bias": np.zeros(TAGS),
                  "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {d + "x": matrix(embed, 4 * hidden), d + "h": matrix(hidden, 4 * hidden), d + "b": np.zeros(4 * hidden)}
            self.p[d + "b"][hidden:2 * hidden] = 1.0  # remember by default

    def _lstm(self, d: str, x: np.ndarray):
        h, size = np.zeros((x.shape[1], self.hidden)), self.hidden
        c, out, kept = np.zeros_like(h), [], []
        gates = x @ self.p[d + "x"] + self.p[d + "b"]
        for t in range(len(x)):
            z = gates[t] + h @ self.p[d + "h"]
            i, f, o = (_sigmoid(z[:, k * size:(k + 1) * size]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * size:])
            before, prev = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out.append(h)
            kept.append((i, f, o, g, before, prev, tc))
        return np.stack(out), kept

    def emissions(self, codes: np.ndarray):
        """(time, batch, TAGS) from codes (batch, time)."""
        x = self.p["emb"][codes.T]
        fwd, keep_f = self._lstm("f", x)
        bwd, keep_b = self._lstm("b", x[::-1])
        both = np.concatenate([fwd, bwd[::-1]], 2)
        return both @ self.p["out"] + self.p["bias"], (x, both, keep_f, keep_b)

    def graph(self) -> bytes:
        """An ONNX model: the scores of the tags (time, TAGS, batch) of codes (time, batch), without
        bias, in single precision. A step of either direction is the body of a Scan. What a code
        feeds to the gates is looked up; code CODES closes all gates, so that past a line's end the
        state stays zero. tanh(x) of the input is 2 sigmoid(2x) - 1, and half the cell is held."""
        size, table = self.hidden, np.float32
        twice = np.repeat([1.0, 2.0], [3 * size, size])
        nodes, weights = [], {"half": np.array([0.5], table)}
        for k, d in enumerate("fb"):
            fed = (self.p["emb"] @ self.p[d + "x"] + self.p[d + "b"]) * twice
            weights |= {d + "x": np.vstack([fed, np.full((1, 4 * size), -100.0)]).astype(table), d + "h": (self.p[d + "h"] * twice).astype(table),
                        d + "out": self.p["out"][k * size:(k + 1) * size].astype(table)}
            step = onnx.graph([
                onnx.node("Gather", [d + "x", "code"], ["fed"]), onnx.node("Gemm", ["h", d + "h", "fed"], ["z"]),
                onnx.node("Sigmoid", ["z"], ["gates"]), onnx.node("Split", ["gates"], ["i", "f", "o", "g"], axis=1, num_outputs=4),
                onnx.node("Sub", ["g", "half"], ["new"]), onnx.node("Mul", ["i", "new"], ["more"]), onnx.node("Mul", ["f", "c"], ["kept"]),
                onnx.node("Add", ["kept", "more"], ["cell"]), onnx.node("Add", ["cell", "cell"], ["whole"]), onnx.node("Tanh", ["whole"], ["shown"]),
                onnx.node("Mul", ["o", "shown"], ["state"]), onnx.node("Gemm", [d + "out", "state"], ["score"], transA=1, transB=1)],
                {}, [("h", "float", ["n", size]), ("c", "float", ["n", size]), ("code", "int32", ["n"])],
                [("state", "float", ["n", size]), ("cell", "float", ["n", size]), ("score", "float", [TAGS, "n"])])
            nodes.append(onnx.node("Scan", ["zero", "zero", "codes"], [d + "_h", d + "_c", d + "_score"], body=step, num_scan_inputs=1,
                                   scan_input_directions=[k], scan_output_directions=[k]))
        nodes.append(onnx.node("Add", ["f_score", "b_score"], ["scores"]))
        return onnx.model(onnx.graph(nodes, weights, [("codes", "int32", ["t", "n"]), ("zero", "float", ["n", size])],
                                     [("scores", "float", ["t", TAGS, "n"])]))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"session": None}

    def scores(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, TAGS, batch), without bias, from codes (batch, time); what lies past a line's length is not read."""
        if self.session is None:
            options = ort.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1  # a Spark task has one core
            self.session = ort.InferenceSession(self.graph(), options, providers=["CPUExecutionProvider"])
        n, steps = codes.shape
        read = np.where(np.arange(steps)[:, None] < lengths, codes.T, CODES).astype(np.int32)
        return self.session.run(None, {"codes": read, "zero": np.zeros((n, self.hidden), np.float32)})[0]

    def decode(self, codes: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Best tags (batch, time) by Viterbi; what lies past a line's length is not read."""
        n, steps = codes.shape
        lengths = np.full(n, steps) if lengths is None else lengths
        if (np.diff(lengths) > 0).any():  # longer lines first
            order = np.argsort(-lengths, kind="stable")
            tags = np.empty((n, steps), np.int8)
            tags[order] = self.decode(codes[order], lengths[order])
            return tags
        live = (n - np.searchsorted(lengths[::-1], np.arange(steps), "right")).tolist()
        scores = self.scores(codes, lengths)
        scores += self.p["bias"].astype(np.float32)[:, None]
        scores[0] += self.p["first"].astype(np.float32)[:, None]
        trans = self.p["trans"].astype(np.float32)
        # with O ahead of each other tag by this, the best way to any tag comes from O
        ahead = (trans[1:] - trans[0]).max(1)[:, None] + np.float32(1e-3)
        from_o, over = trans[0][:, None], np.empty((TAGS - 1, n), np.float32)
        stays = np.ones((steps, n), bool)  # the best way to O comes from O
        best, behind = np.empty((TAGS, n), np.float32), np.empty((TAGS - 1, n), bool)
        for t in range(1, steps):
            now, before = scores[t], scores[t - 1]
            np.add(before[0], from_o, out=best)
            np.add(before[1:], ahead, out=over)
            np.greater(over, before[0], out=behind)
            others = np.flatnonzero(np.logical_or.reduce(behind, 0))
            if len(others):
                ways = before[:, None, others] + trans[:, :, None]
                best[:, others] = top = ways.max(0)
                stays[t, others] = ways[0, 0] == top[0]
            now += best
            if live[t] < n:
                now[:, live[t]:] = before[:, live[t]:]
        tags = np.empty((steps, n), np.int8)
        last = scores[-1].argmax(0)
        tags[-1] = last
        for t in range(steps - 2, -1, -1):
            k = live[t + 1]
            turn = np.flatnonzero((last[:k] != 0) | ~stays[t + 1, :k])
            if len(turn):
                last[turn] = (scores[t][:, turn] + trans[:, last[turn]]).argmax(0)
            tags[t] = last
        return tags.T

    def _back_lstm(self, d: str, x: np.ndarray, kept, dout: np.ndarray, grad: dict) -> np.ndarray:
        dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
        dz = np.zeros((*x.shape[:2], 4 * self.hidden))
        for t in reversed(range(len(x))):
            i, f, o, g, before, prev, tc = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc ** 2)
            z = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                dc * i * (1 - g ** 2)], 1)
            dz[t] = z
            grad[d + "h"] += prev.T @ z
            dh, dc = z @ self.p[d + "h"].T, dc * f
        flat = dz.reshape(-1, dz.shape[2])
        grad[d + "x"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[d + "b"] += flat.sum(0)
        return dz @ self.p[d + "x"].T

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood per window and its gradient."""
        e, (x, both, keep_f, keep_b) = self.emissions(codes)
        steps, n, _ = e.shape
        trans, rows, y = self.p["trans"], np.arange(n), tags.T
        alpha = [e[0] + self.p["first"]]
        for t in range(1, steps):
            alpha.append(_logsumexp(alpha[-1][:, :, None] + trans, 1) + e[t])
        beta = [np.zeros((n, TAGS))]
        for t in range(steps - 1, 0, -1):
            beta.insert(0, _logsumexp(trans + (e[t] + beta[0])[:, None], 2))
        z = _logsumexp(alpha[-1], 1)
        alpha, beta = np.stack(alpha), np.stack(beta)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(alpha + beta - z[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None] - z[None, :, None, None])
        grad["trans"] = pair.sum((0, 1))
        grad["first"] = de[0].sum(0)
        gold = self.p["first"][y[0]] + e[0, rows, y[0]]
        for t in range(steps):
            de[t, rows, y[t]] -= 1
            if t:
                gold = gold + trans[y[t - 1], y[t]] + e[t, rows, y[t]]
                np.add.at(grad["trans"], (y[t - 1], y[t]), -1)
        np.add.at(grad["first"], y[0], -1)
        grad["out"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS)
        grad["bias"] = de.sum((0, 1))
        dboth = de @ self.p["out"].T
        dx = self._back_lstm("f", x, keep_f, dboth[:, :, :self.hidden], grad)
        dx += self._back_lstm("b", x[::-1], keep_b, dboth[::-1, :, self.hidden:], grad)[::-1]
        np.add.at(grad["emb"], codes.T, dx)
        return float((z - gold).mean()), {k: g / n for k, g in grad.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01,
            seed: int = 5) -> Tagger:
        rng, self.session = np.random.default_rng(seed), None
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                _, grad = self.gradient(codes[pick], tags[pick])
                step += 1
                norm = np.sqrt(sum((g ** 2).sum() for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return self


def stretches(length: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping stretches that cover a whole text."""
    last = max(1, length - SHARED)
    return [(a, min(a + SPAN, length)) for a in range(0, last, SPAN - SHARED)] if length else []


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows over every stretch near a digit, an @ or the
    words of a spelt-out address, from which the training sample is drawn."""
    out: list[int] = []
    stretch = None
    near = ((m.start(), m.end()) for m in _TRIGGER.finditer(text))
    low = text.lower()
    if any(w in low for w in _DOT_WORDS):
        near = merge(near, ((m.start(), m.end()) for m in _SPELT.finditer(text)))
    for start, end in near:
        a, b = max(0, start - REACH), min(len(text), end + REACH)
        if stretch and a <= stretch[1]:
            stretch = (stretch[0], max(stretch[1], b))
            continue
        if stretch:
            out += _cut(*stretch)
        stretch = (a, b)
    return out + (_cut(*stretch) if stretch else [])


def _cut(a: int, b: int) -> list[int]:
    return list(range(a, max(a + 1, b - WINDOW + STEP), STEP))


def _tags(spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    """Gold tags of a window; spans that begin before it are not labelled B."""
    tags = np.zeros(WINDOW, np.int64)
    for a, k, b in spans:
        lo, hi = max(a - start, 0), min(b - start, WINDOW)
        if lo < hi and not tags[lo:hi].any():
            tags[lo:hi] = 2 + 2 * k
            if a >= start:
                tags[lo] = 1 + 2 * k
    return tags


def _varied(rng: np.random.Generator, kind: int) -> str:
    """A made-up value of a kind as people also write it."""
    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(rng.choice(list("abcdefghilmnoprstuvw"), rng.integers(3, 9)))

    if kind == 0:
        spelt = rng.random() < 0.5
        at = rng.choice([" at ", " (at) ", " [at] ", " AT "] if spelt else ["@", " @ ", "@ ", " @"])
        dot = rng.choice([" dot ", " (dot) ", " DOT ", "."]) if spelt else "."
        if spelt and rng.random() < 0.5:
            at, dot = rng.choice([" arroba ", " chez ", " at "]), rng.choice([" punto ", " point ", " punkt "])
        return f"{word()}{rng.choice(['.', '_', ''])}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
    if kind == 1:
        return rng.choice([".", " . "]).join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = digits(15)
        check = next(str(c) for c in range(10) if luhn(body + str(c)))
        sep = rng.choice(["", " ", "-", "."])
        full = body + check
        return sep.join(full[i:i + 4] for i in range(0, 16, 4))
    lead = rng.choice(["+", "00", "tel ", "("])
    parts = [digits(n) for n in (2, 3, 4, 4)]
    return (lead if lead != "tel " else "") + (parts[0] + ")" if lead == "(" else parts[0]) + rng.choice(["-", " ", "."]) + rng.choice(["-", " "]).join(parts[1:])


def labelled_windows(docs: DataFrame, id_col: str, text_col: str, max_docs: int, max_windows: int, seed: int = 11):
    """(codes, tags): windows of at most ``max_docs`` documents that hold a digit
    or @, chosen by a hash of their id, labelled by the base rules. A copy of
    each labelled window has its values rewritten in looser spellings."""
    text = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .filter(F.col("text").rlike("[0-9@]")))
    ids = (text.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = base_spans(t)
                for s in window_starts(t):
                    near = [(a, k, b) for a, k, b in spans if a < s + WINDOW and b > s]
                    rows.append((hashlib.sha256(f"{doc}:{s}".encode()).hexdigest(), t[s:s + WINDOW], str([(a - s, k, b - s) for a, k, b in near])))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["key", "text", "spans"])

    wide = text.join(F.broadcast(ids.distinct()), "doc_id").mapInArrow(cut, "key string, text string, spans string")
    kept = wide.distinct().orderBy("key", "text").limit(max_windows).collect()
    rng = np.random.default_rng(seed)
    codes, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        row = np.zeros(WINDOW, np.int64)
        c = char_codes(text[:WINDOW])
        row[:len(c)] = c
        codes.append(row)
        tags.append(_tags(spans, 0))

    plain = [r["text"] for r in kept] or ["and the of to in"]
    for r in kept:
        spans = [tuple(map(int, s)) for s in re.findall(r"\((-?\d+), (\d), (-?\d+)\)", r["spans"])]
        add(r["text"], spans)
    for i in range(max(400, len(kept) // 2)):
        kind = int(rng.integers(0, len(KINDS)))
        value = str(_varied(rng, kind))[:44]
        around = re.sub("[0-9@+]", "", plain[i % len(plain)])
        cut_at = int(rng.integers(0, max(1, min(len(around), WINDOW - len(value) - 2))))
        add(around[:cut_at] + " " + value + " " + around[cut_at:], [(cut_at + 1, kind, cut_at + 1 + len(value))])
    return np.stack(codes), np.stack(tags)


def tag_texts(tagger: Tagger, texts: list[str], batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Spans by the model alone, decoded over every character of every text. A
    character takes its tag from the stretch in which it stands farthest from an edge."""
    codes = [char_codes(t) for t in texts]
    flat = sorted(((b - a, i, a) for i, t in enumerate(texts) for a, b in stretches(len(t))), reverse=True)
    best = [np.zeros(len(t), np.int8) for t in texts]
    for at in range(0, len(flat), batch):
        part = flat[at:at + batch]
        lengths = np.array([n for n, _, _ in part])
        table = np.zeros((len(part), lengths[0]), np.int64)
        for j, (n, i, s) in enumerate(part):
            table[j, :n] = codes[i][s:s + n]
        for (n, i, s), row in zip(part, tagger.decode(table, lengths), strict=True):
            # two stretches share SHARED characters, half of them nearer to the edge of
            # either; the begin and the end of a text are no edges
            lo, hi = SHARED // 2 if s else 0, n - SHARED // 2 if s + n < len(texts[i]) else n
            best[i][s + lo:s + hi] = row[lo:hi]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, tag in enumerate(best):
        if not tag.any():
            continue
        kind = (tag + 1) // 2 - 1  # -1 for O
        starts = (tag % 2 == 1) | (np.concatenate([[-1], kind[:-1]]) != kind)  # of a span or of what lies between
        edges = np.append(np.flatnonzero(starts), len(tag))
        found[i] = [(int(a), int(kind[a]), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if kind[a] >= 0]
    return found


def accepted(text: str, kind: int) -> bool:
    """Whether a span of the model is kept: it must read as its kind once blanks
    around separators are gone and spelt signs are written out. A number without
    +, 00 or a bracket in front is a phone if it comes in groups of two to five
    digits, 9 to 15 in all, and is no card, address or date."""
    text = text.strip()
    if kind == 0:
        if re.search(r"[^\W_]\.\s", text):  # the end of a sentence
            return False
        text = _SPELT_DOT.sub(".", _SPELT_AT.sub("@", text))
    tight = re.sub(r"\s*([@.])\s*", r"\1", text)
    if kind == 0:
        return list(_emails(tight)) == [(0, len(tight))]
    if kind == 1:
        return bool(_IP.fullmatch(tight)) and plausible("ip", tight)
    if kind == 2:
        return bool(re.fullmatch("[0-9][ 0-9.-]+[0-9]", tight)) and plausible("card", tight)
    if not 9 <= len(_digits(tight)) <= 15:
        return False
    if tight[0] in "+(" or tight.startswith("00"):
        return bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", tight))
    return bool(_GROUPS.fullmatch(tight)) and not (_DATE.match(tight) or plausible("card", tight)
                                                   or (_IP.fullmatch(tight) and plausible("ip", tight)))


#: What a span of each kind may hold, and how far it may grow on either side.
_RUNS = (re.compile(r"[\w.%+@()\[\]-]"), re.compile("[0-9.]"), re.compile("[0-9.-]"), re.compile("[0-9().+-]"))
GROWTH = 24
#: Places where a word, or the marks around it, begin or end.
_EDGE = re.compile(r"(?<=\s)(?=\S)|(?<=\S)(?=\s)|(?<=[^\s.,;:)\]-])(?=[.,;:)\]-]+(?:\s|$))|(?<=[(\[])(?=\w)")


def snapped(text: str, a: int, kind: int, b: int) -> tuple[int, int, int] | None:
    """(start, kind, end): the widest stretch that overlaps a span of the model and
    is accepted, as the span's kind or, if that is a number, as another kind of number.

    A stretch begins and ends at an edge of a word, at most GROWTH characters
    outside the span or anywhere within it, and what lies outside holds only what
    the kind may hold. None if no stretch is accepted."""
    run = _RUNS[kind]
    lo, hi = a, b
    while lo > 0 and a - lo < GROWTH and (run.match(text[lo - 1]) or text[lo - 1] == " "):
        lo -= 1
    while hi < len(text) and hi - b < GROWTH and (run.match(text[hi]) or text[hi] == " "):
        hi += 1
    edges = {a, b, lo, hi, *(lo + m.start() for m in _EDGE.finditer(text[lo:hi]))}
    starts = [x for x in edges if x < b and x < len(text) and text[x] not in " .,;:"]
    ends = sorted(y for y in edges if y > a and text[y - 1] not in " .,;:")
    pairs = [(x - y, x, y, i, k) for i, k in enumerate((kind, *((1, 2, 3) if kind else ())))
             for x, y in _possible(text, lo, hi, starts, ends, k)]
    refused = set()  # numbers, which are short
    for _, x, y, _, k in sorted(pairs):
        if (what := (text[x:y], k)) in refused:
            continue
        if accepted(*what):
            return x, k, y
        if k:
            refused.add(what)
    return None


#: What no accepted stretch of a kind holds: a sign that it cannot have, an end of a
#: sentence. A blank stays out, too, unless it may go, as those at @, points and spelt signs.
_BARS = (re.compile(r"[^A-Za-z0-9._%+@()\[\]{}\s\u0130\u0131\u017f\u212a-]|(?=[^\W_]\.\s)"), re.compile(r"[^0-9.\s]"),
         re.compile(r"[^0-9.\s-]"), re.compile(r"[^0-9+().\s-]"))
_SIGN = re.compile(rf"(?=({'|'.join(_AT_WORDS + _DOT_WORDS)}|[@.]))", re.I)
_AT = re.compile("|".join(_AT_WORDS), re.I)
#: What is counted in an accepted stretch, its least and its most: signs of an address (at
#: most one, but a cut word may look like one more), points, digits.
_COUNTED = ((re.compile("@"), 1, float("inf")), (re.compile("[.]"), 3, 3), (_DIGITS, 12, 19), (_DIGITS, 9, 15))
_ONE_SIGN = re.compile(rf"@|\b(?:{'|'.join(_AT_WORDS)})\b", re.I)


def _signs(part: str, cuts: set[int]) -> list[tuple[int, int]]:
    """(start, end) of @, points and spelt signs that are words or whose word a stretch may
    cut to one, as it begins or ends at one of ``cuts``."""
    def parted(i: int) -> bool:
        return i in cuts or not 0 < i < len(part) or not all(c.isalnum() or c == "_" for c in part[i - 1:i + 1])

    return [(m.start(), m.end(1)) for m in _SIGN.finditer(part) if m[1] in "@." or parted(m.start()) and parted(m.end(1))]


def _may_go(part: str, signs: list[tuple[int, int]], spelt: bool) -> set[int]:
    """Places of the blanks that ``accepted`` may leave out: next to @ or a point or, of
    an address, to a spelt sign, which may have a bracket on either side."""
    out: set[int] = set()

    def run(i: int, step: int) -> int:
        while 0 <= i < len(part) and part[i].isspace() and i not in out:
            out.add(i)
            i += step
        while 0 <= i < len(part) and part[i].isspace():
            i += step
        return i

    for a, b in signs:
        for i, step, brackets in ((a - 1, -1, "([{"), (b, 1, ")]}")):
            i = run(i, step)
            if spelt and 0 <= i < len(part) and part[i] in brackets:
                run(i + step, step)
    return out


def _possible(text: str, lo: int, hi: int, starts: list[int], ends: list[int], kind: int) -> Iterator[tuple[int, int]]:
    """The stretches between the starts and the sorted ends that may be accepted as a kind:
    all that hold no bar and a fitting number of the counted signs."""
    part = text[lo:hi]
    bars = [(m.start(), m.start() + (2 if m.end() == m.start() else 0)) for m in _BARS[kind].finditer(part)]
    signs = _signs(part, {i - lo for i in (*starts, *ends)}) if kind < 2 else []
    if kind < 2:
        free = _may_go(part, signs, kind == 0)
        bars += [(i, i) for i, c in enumerate(part) if c.isspace() and i not in free]
    if kind == 0:
        found = list(_ONE_SIGN.finditer(part))
        bars += [(m.start(), n.end() - 1) for m, n in pairwise(found)]  # from one sign to the next
    if kind == 3:
        bars += [(i - 1, i) for i, c in enumerate(part) if c == "+" and i]  # stands in front only
    bars.sort()
    firsts = [a for a, _ in bars]
    least_last = list(accumulate((b for _, b in reversed(bars)), min))[::-1]
    sign, least, most = _COUNTED[kind]
    is_sign = np.zeros(len(part) + 1, np.int64)
    is_sign[[m.start() + 1 for m in sign.finditer(part)]] = 1
    if kind == 0:
        is_sign[[a + 1 for a, _ in signs if _AT.match(part, a)]] = 1
    count = np.cumsum(is_sign).tolist()
    inner = []  # the ends without blanks before them
    for y in ends:
        e = y - lo
        while e > 0 and part[e - 1].isspace():
            e -= 1
        inner.append(e)
    counts = [count[e] for e in inner]
    for x in starts:
        s = x - lo
        while s < len(part) and part[s].isspace():
            s += 1
        at = bisect_left(firsts, s)
        limit = least_last[at] if at < len(bars) else len(part)
        for j in range(max(bisect_right(ends, x), bisect_left(counts, count[s] + least)), len(ends)):
            if inner[j] > limit or counts[j] - count[s] > most:
                break
            if inner[j] > s:
                yield x, ends[j]


def added(text: str, own: list[tuple[int, int, int]], model: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's spans that are accepted, grown to whole words, and overlap
    neither a base span nor one another; the first of two that overlap stays."""
    taken = sorted((a, b) for a, _, b in own)
    firsts, out, free = [a for a, _ in taken], [], 0
    reach = list(accumulate((b for _, b in taken), max))
    for a, k, b in model:
        found = snapped(text, a, k, b)
        if found is None:
            continue
        a, k, b = found
        before = bisect_left(firsts, b)  # base spans that begin before the end
        if a >= free and (before == 0 or reach[before - 1] <= a):
            out.append((a, k, b))
            free = b
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2000,
                       max_windows: int = 2500) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base rules),
    n_model, base_sha256 and spans (kind:start:end by start, then kind).

    The tagger is trained on a bounded, hash-chosen sample and decodes every
    character of every text. Its
    spans grow to whole words and are added where they overlap no base span and
    read as their kind. Null and empty texts have no spans; rows are independent of each
    other, so repeated ids and other columns do no harm.
    """
    codes, tags = labelled_windows(docs, id_col, text_col, max_docs, max_windows)
    tagger = Tagger().fit(codes, tags)

    def said(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                full = []
                for text, own, model in zip(texts, base, tag_texts(tagger, texts), strict=True):
                    more = added(text, own, model)
                    full.append((own, sorted(own + more), len(more)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([sum(x[1] == k for x in own) for own, _, _ in full], pa.int64())
                                       for k in range(len(KINDS))),
                     pa.array([m for _, _, m in full], pa.int64()),
                     pa.array([hashlib.sha256(said(own).encode()).hexdigest() for own, _, _ in full]),
                     pa.array([said(every) for _, every, _ in full])],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "n_model", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {counts}, n_model long, base_sha256 string, spans string")

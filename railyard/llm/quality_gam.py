"""Quality by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins; boosting goes round the features
in a fixed cycle and each time adds a small tree on that feature's gradient
histogram to its table. The pairs whose joint histogram explains most of what is
left then get two-dimensional tables in the same way. A score is the sum of the
looked-up values, so a document costs one bin search per feature.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _HIGH = b"0123456789", bytes(range(128, 256))
_SYMBOLS = b"#$%&*@^~=+<>{}[]\\_/"
_WORDS = 1 << 18

FEATURES = ("log_words", "word_length", "distinct_words", "top_word", "repeated_next", "distinct_pairs",
            "upper", "digits", "high_bytes", "symbols", "bars", "exclamations", "questions", "full_stops", "commas",
            "double_marks", "words_a_line", "repeated_lines", "long_words")


def features(text: str) -> tuple[float, ...]:
    """FEATURES of a whole text; a text without words is all zeros.

    Words are counted in stretches of 2^18; shares of distinct words and pairs
    are means over the stretches, so memory does not grow with their number."""
    data = text.encode("utf-8", "replace")
    size = len(data)
    n = long_words = same = top = 0
    distinct = pairs = 0.0
    for words in _stretches(text):
        m = len(words)
        counts = Counter(words)
        n += m
        top += max(counts.values())
        distinct += len(counts)
        same += sum(map(eq, words, words[1:]))
        pairs += len(set(zip(words, words[1:]))) + 1
        long_words += sum(c for w, c in counts.items() if len(w) > 18)
    if not n:
        return (0.0,) * len(FEATURES)
    lines = Counter(line for line in text.split("\n") if line)

    def share(marks: bytes) -> int:
        return size - len(data.translate(None, marks))

    letters = share(_LOWER) + share(_UPPER)
    return (np.log1p(n), size / n, distinct / n, top / n, same / n, pairs / n,
            share(_UPPER) / max(letters, 1), share(_DIGITS) / size, share(_HIGH) / size, share(_SYMBOLS) / n,
            data.count(b"|") / n, data.count(b"!") / n, data.count(b"?") / n, data.count(b".") / n, data.count(b",") / n,
            sum(data.count(2 * bytes([c])) for c in b"!?#$%&*-=") / n, n / max(sum(lines.values()), 1),
            1 - len(lines) / max(sum(lines.values()), 1), long_words / n)


def _stretches(text: str):
    """The words of a text, so many at a time."""
    if len(text) <= 2 * _WORDS:
        words = text.split()
        if words:
            yield words
        return
    rest: list[str] = []
    cut = False  # whether a word goes on in the next piece
    for start in range(0, len(text), _WORDS):
        piece = text[start:start + _WORDS]
        words = piece.split()
        if cut and not piece[0].isspace():
            words[0] = rest.pop() + words[0]
        rest += words
        cut = not piece[-1].isspace()
        if len(rest) > _WORDS:
            yield rest[:-1]
            rest = rest[-1:]
    if rest:
        yield rest


@dataclass
class PairwiseGam:
    """Logistic boosting of per-feature and per-pair lookup tables.

    ``rounds`` cycles over the features with trees of at most ``leaves`` leaves,
    then ``pair_rounds`` over the ``pairs`` best pairs with four-cell trees.
    ``least`` is the smallest number of rows in a leaf.
    """

    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.15
    bins: int = 32
    pair_bins: int = 10
    leaves: int = 3
    pairs: int = 6
    least: int = 5
    shrink: float = 1.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    pair_tables: dict = field(default_factory=dict)  # (feature, feature) -> table over the bins of both

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> PairwiseGam:
        self.edges, self.pair_edges = self._edges(x, self.bins), self._edges(x, self.pair_bins)
        fine, coarse = self._bin(x, self.edges), self._bin(x, self.pair_edges)
        p = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                step = self._tree(fine[:, j], len(table), *self._slopes(score, y, weight))
                table += step
                score += step[fine[:, j]]
        for a, b in self._best_pairs(coarse, score, y, weight):
            self.pair_tables[a, b] = np.zeros((len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1))
        for _ in range(self.pair_rounds):
            for (a, b), table in self.pair_tables.items():
                step = self._cells(coarse[:, a], coarse[:, b], table.shape, *self._slopes(score, y, weight))[1]
                table += step
                score += step[coarse[:, a], coarse[:, b]]
        return self

    @staticmethod
    def _slopes(score, y, weight):
        q = 1 / (1 + np.exp(-score))
        return weight * (q - y), np.maximum(weight * q * (1 - q), 1e-9)

    def _tree(self, at: np.ndarray, width: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Values by bin of a tree on one feature, its best cuts taken in turn."""
        gs, hs, ns = np.bincount(at, g, width), np.bincount(at, h, width), np.bincount(at, minlength=width)
        cuts = [0, width]
        for _ in range(self.leaves - 1):
            best = (1e-9, None)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo < 2:
                    continue
                gl, hl, nl = (np.cumsum(v[lo:hi])[:-1] for v in (gs, hs, ns))
                gt, ht, nt = gs[lo:hi].sum(), hs[lo:hi].sum(), ns[lo:hi].sum()
                gain = gl ** 2 / (hl + self.shrink) + (gt - gl) ** 2 / (ht - hl + self.shrink) - gt ** 2 / (ht + self.shrink)
                gain[(nl < self.least) | (nt - nl < self.least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), lo + 1 + int(gain.argmax()))
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(width)
        if len(cuts) > 2:
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                out[lo:hi] = -self.rate * gs[lo:hi].sum() / (hs[lo:hi].sum() + self.shrink)
        return out

    def _cells(self, a, b, shape, g, h) -> tuple[float, np.ndarray]:
        """Gain and values of the best cut of two features into four cells."""
        flat, size = a * shape[1] + b, shape[0] * shape[1]
        sums = [np.bincount(flat, v, size).reshape(shape).cumsum(0).cumsum(1) for v in (g, h, np.ones(len(g)))]
        out = np.zeros(shape)
        if min(shape) < 2:
            return 0.0, out
        gain, quarters = 0.0, []
        for s in sums:
            inner, right, below, total = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
            quarters.append((inner, right - inner, below - inner, total - right - below + inner))
        gain = sum(gq ** 2 / (hq + self.shrink) for gq, hq in zip(quarters[0], quarters[1], strict=True))
        gain = gain - sums[0][-1, -1] ** 2 / (sums[1][-1, -1] + self.shrink)
        gain = np.where(np.min(quarters[2], axis=0) < self.least, 0, gain)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] <= 1e-9:
            return 0.0, out
        values = [-self.rate * quarters[0][q][i, j] / (quarters[1][q][i, j] + self.shrink) for q in range(4)]
        out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
        return float(gain[i, j]), out

    def _best_pairs(self, coarse, score, y, weight) -> list[tuple[int, int]]:
        g, h = self._slopes(score, y, weight)
        widths = [len(e) + 1 for e in self.pair_edges]
        gains = {(a, b): self._cells(coarse[:, a], coarse[:, b], (widths[a], widths[b]), g, h)[0]
                 for a, b in combinations(range(len(widths)), 2)}
        return [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:self.pairs] if gains[p] > 0]

    def margin(self, x: np.ndarray) -> np.ndarray:
        fine = self._bin(x, self.edges)
        out = self.base + sum((t[fine[:, j]] for j, t in enumerate(self.tables)), np.zeros(len(x)))
        if self.pair_tables:
            coarse = self._bin(x, self.pair_edges)
            for (a, b), table in self.pair_tables.items():
                out += table[coarse[:, a], coarse[:, b]]
        return out


def may_learn(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be used: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int = 12_000, id_col: str = "doc_id",
        text_col: str = "text", **how) -> PairwiseGam:
    """A model from at most ``max_rows`` labelled documents, half of them of each
    label, chosen by a hash of the id among the rows of ``labels`` (doc_id,
    quality) that satisfy ``allowed``. Rows weigh as many labels as they stand
    for, so the sample's shares do not shift the scores. Null ids and labels are
    left out; of repeated labels the smallest counts. Labels of one kind or none
    give a constant: that kind's score, or 0.5.
    """
    known = (labels.filter(allowed & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")))
    chosen = None
    for kind in (0, 1):
        rows = (known.filter(F.col("_quality") == kind).orderBy(F.xxhash64("_id"), "_id").limit(max_rows // 2))
        chosen = rows if chosen is None else chosen.union(rows)
    full = {r["_quality"]: r["n"] for r in known.groupBy("_quality").agg(F.count("*").alias("n")).collect()}
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sample = written(text.join(F.broadcast(chosen), "_id"), "quality-labelled")  # at most max_rows ids

    def dense(batches):
        for pdf in batches:
            x = pd.DataFrame([features(t) for t in pdf["_text"]], columns=list(FEATURES))
            yield x.assign(doc_id=pdf["_id"].astype(str).to_numpy(), quality=pdf["_quality"].to_numpy())

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", doc_id string, quality int"
    table = sample.mapInPandas(dense, schema).toPandas().sort_values(["doc_id", *FEATURES])  # at most max_rows
    y = table["quality"].to_numpy(float)
    model = PairwiseGam(**how)
    if len(set(y)) < 2:
        model.base = float(np.log(1e4)) * (2 * y[0] - 1) if len(y) else 0.0
        model.edges, model.tables = [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES)
        return model
    weight = np.where(y == 1, full[1] / y.sum(), full[0] / (1 - y).sum())
    return model.fit(table[list(FEATURES)].to_numpy(), y, weight / weight.mean())


def score_column(model: PairwiseGam, text_col: str = "text") -> Column:
    """Score of a text between 0 and 1, higher for likelier good; null counts as empty."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([features(t or "") for t in text]).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-model.margin(x))))

    return score(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
                    text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null texts count
    as empty, null ids are not held out; other columns are not read."""
    model = fit(docs, labels, may_learn(), id_col=id_col, text_col=text_col, **how)
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .withColumn("score", score_column(model))
            .select("doc_id", F.coalesce(~may_learn(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))

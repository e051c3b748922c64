"""Toxicity by gradient-boosted trees over dense text features, calibrated isotonically."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: A general list of insults and second-person words in four languages.
INSULTS = frozenset("""
idiot idiots stupid moron moronic dumb loser losers scum trash garbage filth filthy pathetic worthless disgusting
clown fool ugly liar coward imbecile jerk creep vermin parasite degenerate hateful despicable
idiota estúpido estúpida imbécil basura asqueroso patético inútil payaso cretino
idiote stupide imbécile ordure dégoûtant pathétique minable crétin abruti bouffon
dumm dummkopf trottel abschaum müll widerlich erbärmlich wertlos versager
""".split())
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine tu te toi vous ton votre usted tú ti vos".split())
_MASKED = str.maketrans({"@": "a", "0": "o", "1": "i", "3": "e", "$": "s", "5": "s", "4": "a", "7": "t", "*": "", "!": "i"})
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…-–—*_"
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[@013$547*!])[\w@$*!]+")
STEM = 5
PLAIN, YOU, CAPS, MASKED, POINT, LEXICON = 0, 1, 2, 3, 4, 5
_UPPER = bytes(range(65, 91))
_POINTS = b"!?"

FEATURES = ("lexicon_density", "lexicon_weight", "lexicon_distinct", "insult_density", "insult_count",
            "near_you", "you_density", "caps_rate", "capital_letters", "points", "point_words",
            "masked_rate", "masked_hits", "log_words")


class WordCodes(dict):
    """Code of a raw word, worked out once per distinct word."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon
        #: lexicon entries follow the flags; then, doubled, those found only unmasked
        self.size = len(lexicon)

    def _hit(self, word: str) -> int:
        at = self.lexicon.get(word, -1)
        return at if at >= 0 or len(word) <= STEM else self.lexicon.get(word[:STEM] + "~", -1)

    def __missing__(self, raw: str) -> int:
        if len(self) > 250_000:
            self.clear()
        bare = raw.strip(_EDGE)
        low = bare.lower()
        at, code = self._hit(low), PLAIN
        if at >= 0:
            code = LEXICON + at
        elif not bare:
            code = POINT
        elif low in SECOND_PERSON:
            code = YOU
        elif _MIXED.fullmatch(raw.lower().rstrip(".,")) and not bare.isdigit():
            at = self._hit(raw.lower().rstrip(".,").translate(_MASKED))
            code = LEXICON + self.size + at if at >= 0 else MASKED
        elif len(bare) > 2 and bare.isupper():
            code = CAPS
        self[raw] = code
        return code


def features(texts: list[str], codes: WordCodes, weights: np.ndarray, insult: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) over whole texts; a text without words is all zeros.

    ``weights`` and ``insult`` run over the lexicon entries: their log odds, and
    whether they are on the general list."""
    out = np.zeros((len(texts), len(FEATURES)))
    size = codes.size
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        found = np.fromiter(map(codes.__getitem__, words), np.int64, n)
        count = np.bincount(found, minlength=LEXICON + 2 * size)
        hits = count[LEXICON:LEXICON + size] + count[LEXICON + size:]
        near = 0
        if count[YOU] and hits.any():
            you, at = np.flatnonzero(found == YOU), np.flatnonzero(found >= LEXICON)
            j = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(j, len(you) - 1)] - at), np.abs(you[np.maximum(j - 1, 0)] - at))
            near = int((gap <= 5).sum())
        data = text.encode("utf-8", "replace")
        out[i] = (hits.sum() / n, weights @ (hits > 0), (hits > 0).sum(), insult @ hits / n, insult @ hits,
                  near / n, count[YOU] / n, count[CAPS] / n,
                  (len(data) - len(data.translate(None, _UPPER))) / len(data),
                  (len(data) - len(data.translate(None, _POINTS))) / n, count[POINT] / n,
                  count[MASKED] / n, count[LEXICON + size:].sum(), np.log1p(n))
    return out


@dataclass
class BoostedTrees:
    """Logistic boosting of depth-limited trees on binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    leaf: int = 10
    shrink: float = 1.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)  # (feature, bin, value) arrays in heap order

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, q - y, q * (1 - q))
            self.trees.append(tree)
            score += self._walk(binned, tree)
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        at = np.zeros(len(g), int)
        for node in range(nodes):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[node] = -self.rate * gs / (hs + self.shrink)
            if node >= nodes // 2:
                continue
            best = (1e-6, -1, 0)
            for j in range(binned.shape[1]):
                width = len(self.edges[j]) + 1
                b = binned[mine, j]
                gl = np.cumsum(np.bincount(b, g[mine], width))[:-1]
                hl = np.cumsum(np.bincount(b, h[mine], width))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=width))[:-1]
                gain = gl ** 2 / (hl + self.shrink) + (gs - gl) ** 2 / (hs - hl + self.shrink) - gs ** 2 / (hs + self.shrink)
                gain[(nl < self.leaf) | (len(mine) - nl < self.leaf)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                at[mine] = 2 * node + 1 + (binned[mine, best[1]] > best[2])
        return feature, cut, value

    def _walk(self, binned: np.ndarray, tree) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (binned[rows, np.maximum(f, 0)] > cut[at]))
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum((self._walk(binned, t) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing weighted least-squares fit (pool adjacent violators)."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weighted sum of y, weight, lowest score, highest score
    for s, t, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([float(t * w), float(w), s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return xs, ys


@dataclass
class ToxicModel:
    lexicon: dict[str, int]
    weights: np.ndarray
    insult: np.ndarray
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, texts: list[str], codes: WordCodes) -> np.ndarray:
        x = features(texts, codes, self.weights, self.insult)
        if self.trees is None:  # too few labels of either kind (see fit): the general list alone
            return 1 - np.exp(-x[:, FEATURES.index("insult_count")])
        margin = self.trees.margin(x)
        # a little of the margin keeps the order inside the flat parts
        return np.clip(0.98 * np.interp(margin, *self.knots) + 0.02 / (1 + np.exp(-margin)), 0, 1)


def _tokens(text: str) -> Column:
    """Distinct lower-case words, and stems of the longer ones marked with ~."""
    words = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " ")
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM),
                        lambda w: F.concat(F.substring(w, 1, STEM), F.lit("~")))
    return F.array_remove(F.array_distinct(F.concat(words, stems)), "")


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = 12_000, max_lexicon: int = 400,
        least: int = 30, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """A model from at most ``max_rows`` labelled documents, chosen by a hash of
    their id among the rows of ``labels`` (doc_id, toxic) that satisfy
    ``may_learn``; null labels and ids are left out, of repeated labels the
    largest counts. Toxic rows may fill half of the sample, the rarer label up to
    all of its rows; the calibration weighs each row by the labels it stands
    for, so scores keep the full table's share of toxic documents.

    With fewer than ``least`` labels of either kind, trees and calibration cannot
    be fitted: a score is then 1 - exp(-hits of the general list).

    The lexicon holds the general list and the words and stems whose presence
    is significantly more likely in toxic documents, counted by Spark. Scores of
    three held-out folds feed the calibration, the trees are fitted on all.
    """
    known = (labels.filter(may_learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    full = dict(known.groupBy("toxic").count().collect())  # two rows
    n_bad = min(full.get(1, 0), max(max_rows // 2, max_rows - full.get(0, 0)))
    rows = None
    for kind, n in ((1, n_bad), (0, max_rows - n_bad)):
        part = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        rows = part if rows is None else rows.union(part)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = written(text.join(F.broadcast(rows), "doc_id"), "labelled")  # at most max_rows ids
    counts = dict(sample.groupBy("toxic").count().collect())
    bad, good = counts.get(1, 0), counts.get(0, 0)
    general = {w: np.log(20.0) for w in INSULTS}
    if min(bad, good) >= least:
        seen = (sample.select("toxic", F.explode(_tokens("text")).alias("token")).groupBy("token")
                .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
        odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
        # the token's own deviance: how unlikely its share of toxic documents is by chance
        share = bad / (bad + good)
        worth = (F.col("bad") * F.log((F.col("bad") + 1e-9) / ((F.col("bad") + F.col("good")) * share))
                 + F.col("good") * F.log((F.col("good") + 1e-9) / ((F.col("bad") + F.col("good")) * (1 - share))))
        top = (seen.filter("bad >= 3").withColumn("odds", odds).withColumn("worth", worth)
               .filter("odds > 2 and worth > 6").orderBy(F.desc("worth"), "token").limit(max_lexicon)
               .select("token", "odds").collect())
        general |= {r["token"]: r["odds"] for r in top}
    names = sorted(general)
    lexicon = {w: i for i, w in enumerate(names)}
    weights = np.array([general[w] for w in names])
    insult = np.array([float(w in INSULTS) for w in names])
    model = ToxicModel(lexicon, weights, insult, None, None)
    if min(bad, good) < least:
        return model

    def dense(batches):
        codes = WordCodes(lexicon)
        for pdf in batches:
            x = pd.DataFrame(features(pdf["text"].tolist(), codes, weights, insult), columns=list(FEATURES))
            yield x.assign(doc_id=pdf["doc_id"].to_numpy(), toxic=pdf["toxic"].to_numpy())

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", doc_id long, toxic int"
    table = sample.mapInPandas(dense, schema).toPandas().sort_values(["doc_id", *FEATURES])  # at most max_rows
    x, y = table[list(FEATURES)].to_numpy(), table["toxic"].to_numpy(float)
    fold = np.arange(len(y)) % 3
    out = np.zeros(len(y))
    for k in range(3):
        out[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    weight = np.where(y == 1, full[1] / y.sum(), full[0] / (1 - y).sum())
    shift = float(np.log(full[1] / full[0]) - np.log(y.sum() / (1 - y).sum()))
    model.trees, model.knots = BoostedTrees().fit(x, y), isotonic(out + shift, y, weight)
    model.trees.base += shift
    return model


def score_column(model: ToxicModel, text_col: str = "text") -> Column:
    """Score of a text between 0 and 1, higher for likelier toxic; null counts as empty."""
    codes = WordCodes(model.lexicon)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score([t or "" for t in text], codes))

    return score(F.col(text_col))


def may_learn(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be used: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id",
                    text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null texts count
    as empty, null ids are not held out; other columns are not read."""
    model = fit(docs, labels, may_learn(), id_col=id_col, text_col=text_col, **how)
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .withColumn("score", score_column(model))
            .select("doc_id", F.coalesce(~may_learn(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id",
               text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    model = fit(docs, labels, may_learn(), id_col=id_col, text_col=text_col, **how)
    score, = unused(docs, "_score")
    return docs.withColumn(score, score_column(model, text_col)).filter(F.col(score) < threshold).drop(score)

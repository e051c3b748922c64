"""Spelling variants by a dictionary of trie-node pairs.

Every distinct prefix of a word is a node of the forward trie, every distinct
suffix a node of the reversed one; both get integers. A word with one position
skipped is the pair (node of the prefix before it, node of the suffix behind
it), a word cut at a position the pair of the two nodes there. Equal pairs of
two skipped words are a replacement, of a skipped and a cut word an insertion,
so one equi-join by integers finds all words at distance one, and only those.

A pair's group holds at most one cut word and one skipped word per letter, so
groups are bounded by the alphabet. A letter within a run of the same letter can
be skipped at each place of the run; for insertions only the first counts, so
each near word is counted once.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Latin-1 bytes: A-Z in lower case, a-z and À-ÿ as they are, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_PIECE = 1 << 22
_FLUSH = 400_000
_SHIFT = 40
#: Only words up to this length serve as bounds of the sorted ranges.
_BOUND = 64


class Runs(dict):
    """Numbers distinct runs (Latin-1 bytes) and keeps crc32 and length of their UTF-8."""

    def __init__(self):
        super().__init__()
        self.crc, self.size = array("I"), array("q")

    def __missing__(self, run: bytes) -> int:
        data = run.decode("latin-1").encode()
        self[run] = at = len(self.crc)
        self.crc.append(zlib.crc32(data))
        self.size.append(len(data))
        return at


def pieces(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters of a whole text, in pieces of some megabytes."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + _PIECE) if start + _PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class TypoCounter:
    """Counts runs; where ``every`` divides the crc32 of ``<doc_id>:<run>`` the
    run loses its code point crc32 % length.

    crc32 is affine: the sum of prefix and run is the run's own sum xor a term
    that depends on the prefix and the run's length only, so whole arrays of
    runs are tested at once.
    """

    def __init__(self, every: int, least: int):
        self.every, self.least = every, least
        self.zero = {}
        self.reset()

    def reset(self) -> None:
        self.runs, self.kept, self.waiting, self.spoilt = Runs(), [], 0, Counter()
        self.count = np.zeros(0, np.int64)

    def _shift(self, start: int, size: int) -> int:
        if size not in self.zero:
            self.zero[size] = zlib.crc32(bytes(size))
        return zlib.crc32(bytes(size), start) ^ self.zero[size]

    def add(self, doc_id: str, text: str) -> None:
        start = zlib.crc32(f"{doc_id}:".encode())
        for words in pieces(text):
            if not words:
                continue
            ids = np.fromiter(map(self.runs.__getitem__, words), np.int64, len(words))
            # views of growing arrays: taken, indexed and let go at once
            sizes = np.frombuffer(self.runs.size, np.int64)[ids]
            lengths = np.unique(sizes)
            shift = np.array([self._shift(start, int(n)) for n in lengths], np.uint32)
            h = shift[np.searchsorted(lengths, sizes)] ^ np.frombuffer(self.runs.crc, np.uint32)[ids]
            for i in np.flatnonzero(h % self.every == 0):
                word, at = words[i], int(h[i]) % len(words[i])
                self.spoilt[word[:at] + word[at + 1:]] += 1
                ids[i] = -1
            self.kept.append(ids)
            self.waiting += len(ids)
            if self.waiting > 1_000_000:
                self._fold()

    def _fold(self) -> None:
        more = np.bincount(np.concatenate(self.kept) + 1, minlength=len(self.runs) + 1)[1:]
        more[:len(self.count)] += self.count
        self.count, self.kept, self.waiting = more, [], 0

    def counts(self) -> pa.RecordBatch:
        """(word, n) so far of words with ``least`` code points or more; starts anew."""
        if self.waiting:
            self._fold()
        total = Counter({w: n for w, n in self.spoilt.items() if len(w) >= self.least})
        for word, n in zip(self.runs, self.count.tolist(), strict=True):
            if n and len(word) >= self.least:
                total[word] += n
        self.reset()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()),
                                           pa.array(list(total.values()), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, least: int = 6, occurrences: int = 5, every: int = 199, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of all whole texts, as :class:`TypoCounter`
    leaves them, of ``least`` code points and ``occurrences`` in all. A null text
    has none, a null id reads as the empty text. Counts are summed within a task
    before the shuffle, so frequent words are no hot keys."""

    def count(batches):
        counter = TypoCounter(every, least)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                counter.add(doc_id or "", text.as_py() or "")
                if len(counter.runs) + len(counter.spoilt) > _FLUSH:
                    yield counter.counts()
        yield counter.counts()

    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences))


def _walk(bounds: list[str], forward: bool) -> Callable:
    """Numbers the trie nodes of sorted words, range by range.

    A prefix found in two ranges lies around the bound between them and is
    therefore a prefix of that bound: those get negative numbers, alike in every
    task. All others belong to one range and are numbered where they first
    appear in its sorted words.
    """
    shared = {p: -1 - i for i, p in enumerate(sorted({b[:i] for b in bounds for i in range(len(b) + 1)}))}

    def walk(batches):
        part, before, nodes, n_nodes, n_words = None, "", [], 0, 0
        for batch in batches:
            rows = []
            for p, key, word, n in zip(*[batch[c].to_pylist() for c in ("part", "key", "word", "n")], strict=True):
                if p != part:
                    part, before, nodes, n_nodes, n_words = p, "", [], 0, 0
                same = len(commonprefix((before, key))) if nodes else -1
                nodes = nodes[:same + 1]
                while len(nodes) <= len(key) and len(nodes) <= _BOUND:
                    known = shared.get(key[:len(nodes)])
                    if known is None:
                        break
                    nodes.append(known)
                fresh = len(key) + 1 - len(nodes)
                nodes.extend(range((p << _SHIFT) + n_nodes, (p << _SHIFT) + n_nodes + fresh))
                n_nodes += fresh
                before = key
                row = {"word": word, "nodes": list(nodes)}
                if forward:
                    first = [not i or c != word[i - 1] for i, c in enumerate(word)]
                    row |= {"n": n, "word_no": (p << _SHIFT) + n_words, "first": first}
                n_words += 1
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_FORWARD if forward else _BACKWARD)

    return walk


_BACKWARD = pa.schema({"word": pa.string(), "nodes": pa.list_(pa.int64())})
_FORWARD = pa.schema([*_BACKWARD, ("n", pa.int64()), ("word_no", pa.int64()), ("first", pa.list_(pa.bool_()))])


def trie_nodes(words: DataFrame, forward: bool) -> DataFrame:
    """The node numbers of all prefixes of every word, or of all its suffixes, by
    length from 0. Forward also gives ``word_no``, which ascends with the word in
    code-point order, and whether each letter differs from the one before it.

    Ranges of the sorted words are told apart by at most as many bounds as there
    are shuffle partitions; any choice of bounds gives right results.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("word") if forward else F.reverse("word")
    keyed = words.select("word", "n", key.alias("key"))
    bounds = sorted(r.key for r in keyed.filter(F.length("key") <= _BOUND)
                    .orderBy(F.xxhash64("key"), "key").limit(parts - 1).collect())

    def ranges(batches):
        for batch in batches:
            part = [bisect_right(bounds, k) for k in batch["key"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())],
                                             [*batch.schema.names, "part"])

    schema = "word string, nodes array<long>" + (", n long, word_no long, first array<boolean>" if forward else "")
    return (keyed.mapInArrow(ranges, "word string, n long, key string, part long")
            .repartition(parts, "part").sortWithinPartitions("part", "key")
            .mapInArrow(_walk(bounds, forward), schema))


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, n, word_no, skip, first): every word skipped at each position and
    cut at each position, as pairs of trie nodes."""
    skips = F.expr("""transform(sequence(0, size(p) - 2), i ->
        struct(p[i] AS p, s[size(s) - i - 2] AS s, true AS skip, first[i] AS first))""")
    cuts = F.expr("""transform(sequence(0, size(p) - 1), i ->
        struct(p[i] AS p, s[size(s) - i - 1] AS s, false AS skip, false AS first))""")
    return words.select("word_no", "n", F.explode(F.concat(skips, cuts)).alias("x")).select("x.*", "n", "word_no")


def near_words(pairs: DataFrame) -> DataFrame:
    """(word_no, n_near, best): the number of words at distance one and the
    (n, -word_no) of the most frequent of them."""
    groups = (pairs.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("word_no")).alias("no"), "skip", "first"))
                                          .alias("g")).filter(F.size("g") > 1)  # bounded by the alphabet
              .select(F.expr("sort_array(filter(g, x -> x.skip), false)").alias("skips"),
                      F.expr("filter(g, x -> NOT x.skip)").alias("cuts"))
              .withColumn("firsts", F.expr("filter(skips, x -> x.first)")))

    def mine(of: str, count: str, others: str) -> Column:
        return F.expr(f"""transform({of}, m -> struct(-m.no AS word_no, {count} AS n_near,
            array_max(transform({others}, x -> struct(x.n AS n, x.no AS no))) AS best))""")

    skipped = mine("skips", "size(skips) - 1 + IF(m.first, size(cuts), 0)",
                   "concat(IF(m.no = skips[0].no, slice(skips, 2, 1), slice(skips, 1, 1)), IF(m.first, cuts, slice(cuts, 1, 0)))")
    cut = mine("cuts", "size(firsts)", "slice(firsts, 1, 1)")
    return (groups.select(F.explode(F.concat(skipped, cut)).alias("x")).select("x.*").filter("n_near > 0")
            .groupBy("word_no").agg(F.sum("n_near").cast("long").alias("n_near"), F.max("best").alias("best")))


def spelling_groups(docs: DataFrame, least: int = 6, occurrences: int = 5, ratio: int = 5, every: int = 199,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of :func:`word_counts`.

    ``form`` is the most frequent word at distance one (ties: the first in
    code-point order) if it is at least ``ratio`` times as frequent, else null;
    ``root`` follows forms to the last. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    words = written(word_counts(docs, least, occurrences, every, id_col, text_col), "words")
    ahead = trie_nodes(words, True).withColumnRenamed("nodes", "p")
    back = trie_nodes(words, False).withColumnRenamed("nodes", "s")
    nodes = written(ahead.join(back, "word"), "word-nodes")
    near = near_words(node_pairs(nodes))
    form = F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.no"))
    found = written(nodes.select("word_no", "word", "n").join(near, "word_no", "left")
                    .select("word_no", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                            form.alias("form_no")), "word-forms")
    # a form is ratio times as frequent: chains are shorter than log(largest n), and each round doubles the step
    most = found.agg(F.max("n")).first()[0] or 1
    steps = 1
    while ratio ** steps < most:
        steps += 1
    links = found.select("word_no", F.coalesce("form_no", "word_no").alias("to"))
    for _ in range(steps.bit_length()):
        links = written(links.join(links.select(F.col("word_no").alias("to"), F.col("to").alias("far")), "to")
                        .select("word_no", F.col("far").alias("to")), "word-roots")
    named = found.select(F.col("word_no").alias("_no"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    out = (found.join(named, F.col("form_no") == F.col("_no"), "left")
           .select("word_no", "word", F.col("_word").alias("form"), "n", "n_near", F.col("_n").alias("form_n"))
           .join(links, "word_no").join(named.select("_no", F.col("_word").alias("root")), F.col("to") == F.col("_no")))
    return out.select("word", "form", "root", "n", "n_near", "form_n")

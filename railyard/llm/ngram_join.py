"""N-gram Jaccard join by signature trees.

Sets of word n-grams are hashed to 64 bits. Two sets of similarity t or more
share one of their first tokens in any common order (prefix filter), so sets
meet by token; an order that puts frequent tokens last keeps the groups small.
In each group a tree holds, at every node, the size range and the OR of the
members' bitmaps; two nodes are descended together only while their largest
possible overlap allows a link. What survives forms blocks, which hold every
link inside; a second traversal with whole sets decides each link exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, unused, written

SKETCH_BITS, SLICE_BITS = 20, 14
LEAF = 8
#: Tokens of the sets that one task compares at once.
PIECE_TOKENS = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class _Words(dict):
    """64-bit hash of a word, kept for the words seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, words: _Words, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text: A-Z are
    lower-cased, words are cut at ASCII white space; fewer words are one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - k + 1)
    out = np.full(n, min(len(w), k), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(w))):
            out = _mix((out ^ w[j:j + n]) * _ODD[j % len(_ODD)] + np.uint64(j))
    return np.unique(out)


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit per token in the next power of two of the set's size, 64 or more."""
    width = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: int, width: int, to: int) -> int:
    """A bitmap of ``width`` as one of ``to``: the halves are combined by OR."""
    while width > to:
        width //= 2
        bits = (bits | bits >> width) & ((1 << width) - 1)
    return bits


class Item:
    """A set in a tree: its size, bitmap, and a number for the union-find."""

    __slots__ = ("key", "n", "bits", "width", "tokens", "at")

    def __init__(self, key, n: int, data: bytes, tokens=None):
        self.key, self.n, self.tokens, self.at = key, n, tokens, -1
        self.bits, self.width = int.from_bytes(data, "little"), len(data) * 8


class Node:
    """Size range, OR of the bitmaps and least count of bits below; at the leaves, items."""

    __slots__ = ("items", "kids", "low", "high", "bits", "width", "least")

    def __init__(self, items: list[Item]):
        self.items, self.low, self.high = items, items[0].n, items[-1].n
        self.kids = None
        self.width = min(i.width for i in items)
        if len(items) > LEAF:
            half = len(items) // 2
            self.kids = (Node(items[:half]), Node(items[half:]))
            self.bits = fold(self.kids[0].bits, self.kids[0].width, self.width) | fold(
                self.kids[1].bits, self.kids[1].width, self.width)
            self.least = min(k.least for k in self.kids) if self.kids[0].width == self.kids[1].width else 0
        else:
            folded = [fold(i.bits, i.width, self.width) for i in items]
            self.bits, self.least = 0, min(f.bit_count() for f in folded)
            for f in folded:
                self.bits |= f


class Linker:
    """Dual traversal over trees, linking items whose similarity is num/100 or
    more: exactly where items carry tokens, else wherever bitmaps allow it.
    Items already in one component are not compared again."""

    def __init__(self, num: int):
        self.num, self.root, self.items = num, [], []
        self.links: list[tuple] = []

    def add(self, item: Item, together: int | None = None) -> Item:
        item.at = len(self.root)
        self.root.append(item.at)
        self.items.append(item)
        if together is not None:
            self.root[item.at] = self.find(together)
        return item

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def need(self, a: int, b: int) -> int:
        """The least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (100 + self.num))

    def fits(self, a: int, b: int) -> bool:
        return 100 * a >= self.num * b and 100 * b >= self.num * a

    def linked(self, a: Item, b: Item) -> bool:
        if not self.fits(a.n, b.n):
            return False
        need, width = self.need(a.n, b.n), min(a.width, b.width)
        x, y = fold(a.bits, a.width, width), fold(b.bits, b.width, width)
        if (x & ~y).bit_count() > a.n - need or (y & ~x).bit_count() > b.n - need:
            return False
        if a.tokens is None:
            return True
        small, large = (a.tokens, b.tokens) if a.n <= b.n else (b.tokens, a.tokens)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        return int((large[at] == small).sum()) >= need

    def pair(self, a: Item, b: Item) -> None:
        x, y = self.find(a.at), self.find(b.at)
        if x != y and self.linked(a, b):
            self.root[max(x, y)] = min(x, y)
            self.links.append((a.key, b.key))

    def one_root(self, node: Node) -> int:
        """The component of all items below, or -1."""
        first = self.find(node.items[0].at)
        return first if all(self.find(i.at) == first for i in node.items) else -1

    def possible(self, a: Node, b: Node) -> bool:
        if 100 * a.high < self.num * b.low or 100 * b.high < self.num * a.low:
            return False
        if a.width == b.width:
            shared = (a.bits & b.bits).bit_count()
            if a.least - shared > a.high - self.need(a.high, b.low) or b.least - shared > b.high - self.need(b.high, a.low):
                return False
        return True

    def within(self, node: Node) -> None:
        if node.kids:
            self.within(node.kids[0])
            self.within(node.kids[1])
            self.between(*node.kids)
            return
        for i, a in enumerate(node.items):
            for b in node.items[i + 1:]:
                self.pair(a, b)

    def between(self, a: Node, b: Node) -> None:
        if not self.possible(a, b):
            return
        root = self.one_root(a)
        if root >= 0 and root == self.one_root(b):
            return
        if a.kids and (not b.kids or len(a.items) >= len(b.items)):
            for kid in a.kids:
                self.between(kid, b)
        elif b.kids:
            for kid in b.kids:
                self.between(a, kid)
        else:
            for x in a.items:
                for y in b.items:
                    self.pair(x, y)


def _sorted_tree(items: list[Item]) -> Node:
    return Node(sorted(items, key=lambda i: (i.n, i.key)))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``keys`` columns, from sorted batches."""
    group: list[tuple] = []
    for part in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group




def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def scan_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """One pass over whole texts: a row per document (set_key: 128 bits of the
    set, set_no: 64 of them, bits: its bitmap), and per task the slices of a
    fixed-size count of tokens by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = _Words(), TaskContext.get().partitionId()
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "text_key", "n", "set_key", "set_no", "bits", "task", "slice", "counts"]

        def nulls(n: int, kind: pa.DataType) -> pa.Array:
            return pa.nulls(n, kind)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t or "", words, k) for t in part.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                for s in sets:
                    np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([int.from_bytes(x[:8], "little", signed=True) if x else None for x in keys], pa.int64()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    nulls(n, pa.int32()), nulls(n, pa.int32()), nulls(n, pa.binary())], names)
        slices = counts.reshape(-1, 1 << SLICE_BITS)
        full = [i for i, s in enumerate(slices) if s.any()]
        n = len(full)
        if n:
            yield pa.RecordBatch.from_arrays([
                nulls(n, pa.int64()), nulls(n, pa.int64()), nulls(n, pa.int64()), nulls(n, pa.binary()),
                nulls(n, pa.int64()), nulls(n, pa.binary()), pa.array([task] * n, pa.int32()),
                pa.array(full, pa.int32()), pa.array([slices[i].tobytes() for i in full], pa.binary())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_key"))
    return written(rows.mapInArrow(run, "doc_id long, text_key long, n long, set_key binary, set_no long, bits binary, "
                                        "task int, slice int, counts binary"), "sets")


def token_classes(scanned: DataFrame) -> np.ndarray:
    """Logarithm of the count of all tokens in each of 2^20 hash slots: a table of
    one fixed size, summed in a tree of 64 tasks' slices at a time."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SLICE_BITS, np.uint64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(c, np.uint32)
        out = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return pa.table({"task": table.column("task")[:1], "slice": table.column("slice")[:1],
                         "counts": pa.array([out], pa.binary())})

    part = scanned.filter("slice is not null").select("task", "slice", "counts")
    tasks = (part.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        part = part.withColumn("task", F.floor(F.col("task") / 64).cast("int"))
        part = part.groupBy("task", "slice").applyInArrow(add, "task int, slice int, counts binary")
        tasks = -(-tasks // 64)
        if tasks <= 1:
            break
    out = np.zeros((1 << SKETCH_BITS - SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    for row in part.select("slice", "counts").collect():  # 2^20 counts in all
        out[row["slice"]] = np.log2(np.frombuffer(row["counts"], np.uint32) + 1.0).astype(np.uint8)
    return out.reshape(-1)


def prefix_tokens(docs: DataFrame, text_col: str, k: int, num: int, classes: np.ndarray) -> DataFrame:
    """(token, set_no): the first tokens of every set, rarest slots first, as many
    as any partner's overlap needs. Copies within a task are given once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                tokens, owner = [], []
                for text in batch.column(0).slice(at, 500).to_pylist():
                    s = shingles(text or "", words, k)
                    if not len(s):
                        continue
                    no = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True)
                    if no in seen:
                        continue
                    seen.add(no)
                    order = (classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                             << np.uint64(58)) | (s >> np.uint64(6))
                    first = len(s) - -(-num * len(s) // 100) + 1
                    tokens.append(_signed(s[np.argsort(order, kind="stable")[:first]]))
                    owner.append(np.full(first, no, np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owner))], ["token", "set_no"])

    return docs.select(text_col).mapInArrow(run, "token long, set_no long")


def candidate_links(tokens: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """(a, b) of set_no: enough links to hold together all sets that may be linked.

    Tokens of one set alone are dropped before the bitmaps are joined on. Each
    token's sets form a tree; its traversal gives a spanning link for each
    component of the pairs that bitmaps allow."""
    from pyspark.sql import Window

    same_token = Window.partitionBy("token")
    shared = (tokens.withColumn("low", F.min("set_no").over(same_token))
              .withColumn("high", F.max("set_no").over(same_token)).filter("low < high").select("token", "set_no"))
    rows = (shared.join(sets.select("set_no", "n", "bits"), "set_no").select("token", "set_no", "n", "bits")
            .repartition("token").sortWithinPartitions("token", "n", "set_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for group in _groups(batches, 1):
            linker = Linker(num)
            items, last = [], None
            for _, no, n, bits in group:
                if no != last:
                    items.append(linker.add(Item(no, n, bits)))
                    last = no
            linker.within(Node(items))
            known.update(linker.links)
            if len(known) > 50_000:
                yield _link_batch(known)
                known = set()
        if known:
            yield _link_batch(known)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _link_batch(links) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _load(rows: list[tuple], linker: Linker, words: _Words, k: int, text_at: int, key_at: int,
          comp_at: int | None = None) -> list[Item]:
    out, first = [], {}
    for row in rows:
        s = shingles(row[text_at] or "", words, k)
        key = bytes(row[key_at])
        if not len(s) or xxhash.xxh3_128_digest(s.tobytes()) != key:
            continue  # another text under a repeated id
        comp = row[comp_at] if comp_at is not None else None
        item = linker.add(Item(key, len(s), bitmap(s), s), first.get(comp) if comp is not None else None)
        if comp is not None:
            first.setdefault(comp, item.at)
        out.append(item)
    return out


def _key_links(links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()),
                                       pa.array([y for _, y in links], pa.binary())], ["a", "b"])


def exact_links(members: DataFrame, num: int, k: int) -> DataFrame:
    """(a, b) of set_key: links that span every component within each (block,
    piece) of ``members`` (block, piece, n, set_key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for group in _groups(batches, 2):
            linker = Linker(num)
            items = _load(group, linker, words, k, 4, 3)
            if len(items) > 1:
                linker.within(_sorted_tree(items))
            if linker.links:
                yield _key_links(linker.links)

    return (members.select("block", "piece", "n", "set_key", "text").repartition("block", "piece")
            .sortWithinPartitions("block", "piece", "n", "set_key").mapInArrow(run, "a binary, b binary"))


def cross_links(members: DataFrame, num: int, k: int) -> DataFrame:
    """(a, b) of set_key across the pieces of large blocks.

    ``members`` (block, piece, set_key, text, comp, size) carry the components
    found so far. A pair still to be compared has a set outside the block's
    largest component, so only those sets are sent to every piece, themselves
    in pieces; trees of both sides are traversed together."""
    by_comp = members.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("sets"))
    main = by_comp.groupBy("block").agg(F.max_by("comp", F.struct("sets", "comp")).alias("main"))
    rows = members.join(main, "block").withColumn("out", F.col("comp") != F.col("main"))
    pieces = rows.groupBy("block").agg(
        F.max("pieces").alias("p"),
        F.ceil(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)) / PIECE_TOKENS).cast("int").alias("q")).filter("q > 0")
    rows = rows.join(pieces, "block")
    own = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).withColumn("side", F.lit(0))
    sent = (rows.filter("out").withColumn("other", F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("q")).cast("int"))
            .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("side", F.lit(1)))
    cols = ["block", "piece", "other", "side", "n", "set_key", "comp", "text"]
    both = own.select(*cols).union(sent.select(*cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for group in _groups(batches, 3):
            linker = Linker(num)
            items = _load(group, linker, words, k, 7, 5, 6)
            sides = {bytes(r[5]): set() for r in group}
            for r in group:
                sides[bytes(r[5])].add(r[3])
            half = [[i for i in items if s in sides[i.key]] for s in (0, 1)]
            if half[0] and half[1]:
                linker.between(_sorted_tree(half[0]), _sorted_tree(half[1]))
            if linker.links:
                yield _key_links(linker.links)

    return (both.repartition("block", "piece", "other").sortWithinPartitions(*cols[:6])
            .mapInArrow(run, "a binary, b binary"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                       num: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, root, text_key.

    Documents whose sets of k-word shingles have a Jaccard similarity of
    num/100 or more are linked; component_id is the smallest id that links
    reach, root names the component by its set. Equal sets are one set
    throughout, so copies cost nothing. Null, empty and blank texts have an
    empty set and are linked with nothing: component_id is their own id, root
    is null. Null ids never become a component_id unless all are null; repeated
    rows give a row each; columns besides the two are ignored.
    """
    scanned = scan_sets(docs, id_col, text_col, k)
    rows = scanned.filter("slice is null")
    sets = written(rows.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("set_no").alias("set_no"), F.first("n").alias("n"),
        F.first("bits").alias("bits")), "distinct-sets")
    tokens = prefix_tokens(docs.select(text_col), text_col, k, num, token_classes(scanned))
    near = components(written(candidate_links(tokens, sets, num), "candidates"))
    blocks = (sets.drop("bits").join(near.select(F.col("id").alias("set_no"), F.col("root").alias("block")), "set_no"))
    large = blocks.groupBy("block").agg(F.ceil(F.sum("n") / PIECE_TOKENS).cast("int").alias("pieces"))
    blocks = blocks.join(large, "block").withColumn(
        "piece", F.pmod(F.xxhash64("set_key"), F.col("pieces")).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = written(texts.join(blocks, texts["doc_id"].eqNullSafe(blocks["rep"]))
                      .select("block", "pieces", "piece", "n", "set_key", "text"), "members")
    links = written(exact_links(members, num, k), "links")
    many = members.filter("pieces > 1")
    if many.limit(1).count():
        links = _join_pieces(many, links, num, k)
    roots = _set_components(links)
    found = rows.join(roots, "set_key", "left").select(
        "doc_id", "n", "text_key", F.coalesce("root", "set_key").alias("root"))
    found = written(found, "rooted")
    least = found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        "root", "text_key")


def _set_components(links: DataFrame) -> DataFrame:
    """(set_key, root) of all sets with links."""
    out = components(links)
    return out.select(F.col("id").alias("set_key"), "root")


def _join_pieces(many: DataFrame, links: DataFrame, num: int, k: int) -> DataFrame:
    """All links, with those across the pieces of large blocks.

    First one set per component and piece is compared with the others of its
    block, in rounds while that shrinks them, so that a large group of near
    copies becomes one component; then ``cross_links`` compares all that is
    still apart."""
    left = None
    for _ in range(8):
        comp = _set_components(links)
        named = many.join(comp, "set_key", "left").withColumn("comp", F.coalesce("root", "set_key")).drop("root")
        reps = named.groupBy("block", "comp").agg(F.min("set_key").alias("set_key"))
        size = reps.count()
        if left is not None and size >= left:
            break
        left = size
        chosen = many.join(reps.select("set_key"), "set_key")
        total = chosen.groupBy("block").agg(F.ceil(F.sum("n") / PIECE_TOKENS).cast("int").alias("p"))
        chosen = chosen.join(total, "block").withColumn(
            "piece", F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("p")).cast("int"))
        links = written(links.union(exact_links(chosen, num, k)), "links")
    return written(links.union(cross_links(named, num, k)), "links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                     num: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id."""
    found = jaccard_components(docs, id_col, text_col, k, num)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    first = found.filter("root is not null").groupBy("root").agg(F.min(key).alias("k")).select("k._id", "k._key")
    empty = found.filter("root is null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    keep = first.union(empty).distinct()
    own, keep_id, keep_key = unused(docs, "_text_key", "_id", "_key")
    keep = keep.select(F.col("_id").alias(keep_id), F.col("_key").alias(keep_key))
    rows = docs.withColumn(own, F.xxhash64(text_col))
    cond = rows[id_col].eqNullSafe(keep[keep_id]) & (rows[own] == keep[keep_key])
    return rows.join(keep, cond, "left_semi").dropDuplicates([id_col, own]).drop(own)

"""Merkle dataset manifest with proofs by pointer jumping.

Every row is a leaf. The leaves of a group form a tree of ``ARITY`` consecutive
nodes per parent; the roots of the groups, in the order of their keys, form the
tree above. A node's *segment* holds, for each level from the node up to some
ancestor, its place in the run and the digests of the run's other nodes. At
first a segment reaches the parent; each round joins the nodes with those nodes
that their segments reach and appends the segments found, so the distance
doubles until every leaf reaches the root. In the round of distance d only
nodes at multiples of 2d extend their segments and only those at odd multiples
of d are looked up, as no other node is ever met again.

Size: a leaf's proof has at most 7 digests of 32 bytes a level. A node looked
up at distance d serves up to 8^d rows, so few nodes mean large groups: up to
``FEW`` nodes are broadcast (their count is checked), and beyond that no node
serves more than about 8/FEW of all leaves, which the shuffle spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ARITY, BITS = 8, 3
#: Rows of a lookup side that may be broadcast.
FEW = 4096
#: A group meets its size and number in blocks of 2^16 leaves.
BLOCK = 16
_SEGMENT = "array<struct<slot: int, others: binary>>"


def leaf_digest(*fields: str) -> Column:
    """sha256, as binary, of the fields' texts: ``-`` for null, else the UTF-8
    byte count, ``:`` and the value."""
    return digest_of(*map(F.col, fields))


def digest_of(*values: Column) -> Column:
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"),
                                                        v.cast("string"))) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(digest) -> Column:
    return F.lower(F.hex(digest))


def _run_digest(nodes: Column) -> Column:
    """Digest of a run: the sha256 of its digests' hex texts, one after the other."""
    return F.unhex(F.sha2(as_hex(nodes), 256))


def numbered(df: DataFrame, order: list[str], name: str, per: str | None = None) -> DataFrame:
    """``df`` with ``nth``, the row's place from 0 in the order of the columns
    ``order`` (nulls first), within equal ``per`` (the first of them) if given.

    A range sort deals the rows out; places add each partition's offset, and
    the offsets are windows over one row per (partition, key).
    """
    # the id of a row is its partition, shifted by 33 bits, plus its place there
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_at", F.monotonically_increasing_id()), name)
    keys = ["_part"] + ([per] if per else [])
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    w = "ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = (rows.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
               .withColumn("_before", F.expr(f"coalesce(sum(_n) OVER ({f'PARTITION BY {per} ' if per else ''}{w}), 0L)"))
               .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", "_before"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (rows.join(offsets, cond).withColumn("nth", F.col("_at") - F.col("_first") + F.col("_before"))
            .select(*df.columns, "nth"))


def _levels(n: Column) -> Column:
    """Levels above ``n`` leaves until one node remains."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)),
                           lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k * BITS) < n))


def _tree(leaves: DataFrame, carry: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Builds the trees of ``leaves`` (tree, height, nth, node, carry columns).

    Returns leaf rows (tree, height, nth, node, segs, carry columns), inner
    nodes (tree, height, level, nth, segs), and roots (tree, node)."""
    member = F.struct("nth", "node", *carry)
    top = leaves.agg(F.max("height")).first()[0] or 0
    level, below, roots, inner, tagged = 0, leaves, None, None, None
    while True:
        done = below.filter(F.col("height") == level).select("tree", "node")
        roots = done if roots is None else roots.union(done)
        if level >= top:
            break
        runs = written(
            below.filter(F.col("height") > level)
            .groupBy("tree", "height", F.shiftright("nth", BITS).alias("up"))
            .agg(F.array_sort(F.collect_list(member if level == 0 else F.struct("nth", "node"))).alias("run")),
            f"{name}-runs{level}")  # at most ARITY members
        nodes = F.expr("aggregate(run, X'', (a, x) -> concat(a, x.node))")
        runs = runs.withColumn("nodes", nodes)
        spread = runs.select("tree", "height", "nodes", F.posexplode("run").alias("slot", "m"))
        others = F.concat(F.expr("substring(nodes, 1, 32 * slot)"), F.expr("substring(nodes, 32 * slot + 33)"))
        segs = F.array(F.struct("slot", others.alias("others"))).cast(_SEGMENT).alias("segs")
        if level == 0:
            tagged = spread.select("tree", "height", "m.nth", "m.node", segs, *[f"m.{c}" for c in carry])
        else:
            step = spread.select("tree", "height", F.lit(level).alias("level"), "m.nth", segs)
            inner = step if inner is None else inner.union(step)
        below = runs.select("tree", "height", F.col("up").alias("nth"), _run_digest(F.col("nodes")).alias("node"))
        level += 1
    alone = leaves.filter("height = 0").withColumn("segs", F.array().cast(_SEGMENT)).select(
        "tree", "height", "nth", "node", "segs", *carry)
    tagged = alone if tagged is None else tagged.union(alone)
    if inner is None:
        inner = tagged.select("tree", "height", F.lit(1).alias("level"), "nth", "segs").limit(0)
    return tagged, inner, roots


def _extend(nodes: DataFrame, found: DataFrame, distance: int, level: Column) -> DataFrame:
    """One round: segments of ``nodes`` that end below the root go on with the
    segment of the node ``distance`` levels up."""
    goal = found.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("nth").alias("_nth"),
                        F.col("segs").alias("_more"))
    cond = ((F.col("tree") == F.col("_tree")) & (level + distance == F.col("_level"))
            & (F.shiftright("nth", BITS * distance) == F.col("_nth")))
    if found.count() <= FEW:
        goal = F.broadcast(goal)
    return (nodes.join(goal, cond, "left")
            .withColumn("segs", F.concat("segs", F.coalesce("_more", F.array().cast(_SEGMENT))))
            .drop("_tree", "_level", "_nth", "_more"))


def _jump(leaves: DataFrame, inner: DataFrame, name: str) -> DataFrame:
    """Leaf rows with segments that reach the root of their tree."""
    top = leaves.agg(F.max("height")).first()[0] or 0
    inner = written(inner, f"{name}-inner")
    distance = 1
    while distance < top:
        found = inner.filter(F.col("level") % (2 * distance) == distance)
        rest = inner.filter(F.col("level") % (2 * distance) == 0)
        leaves = _extend(leaves, found, distance, F.lit(0))
        if 2 * distance < top:
            inner = written(_extend(rest, found, distance, F.col("level")), f"{name}-inner")
        distance *= 2
    return leaves


def _with_tree(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """``rows`` joined with ``trees`` on tree. The trees that hold more than a
    FEW-th of the rows, of which there are fewer than FEW, are broadcast; rows of
    all others meet them in a shuffle in which no key has more than that."""
    if trees.count() <= FEW:
        return rows.join(F.broadcast(trees), "tree")
    least = trees.agg(F.sum("leaves")).first()[0] // FEW
    large, small = trees.filter(F.col("leaves") > least), trees.filter(F.col("leaves") <= least)
    return (rows.filter(F.col("tree_leaves") > least).join(F.broadcast(large), "tree")
            .union(rows.filter(F.col("tree_leaves") <= least).join(small, "tree")))


def proofs(leaves: DataFrame, group: str = "lang", order: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``leaves`` (group, order, leaf as binary, carry columns) with subroot, root
    and proof: an array from the leaf upwards of (slot, others), where ``others``
    joins the digests of the run's other nodes, left to right.

    Leaves of a group ascend by ``order``, nulls first, ties by digest; groups
    ascend by their key, null first, bytewise. An empty table gives no rows.
    Carried columns may have any names but those four of the result.
    """
    out_names = [order, *[c for c in carry if c not in (group, order)]]
    kept = [f"_kept{i}" for i in range(len(out_names))]  # no clash with the names used in here
    # written first, as the range sort reads its input twice
    rows = written(leaves.select(F.col(group).alias("grp"), *[F.col(c).alias(k) for c, k in zip(out_names, kept, strict=True)],
                                 F.col("leaf").alias("node")), "merkle-hashed")
    rows = written(numbered(rows, ["grp", kept[0], "node"], "merkle-rows", per="grp"), "merkle-leaves")
    sizes = written(rows.groupBy("grp").agg(F.count("*").alias("leaves")), "merkle-sizes")
    groups = written(numbered(sizes, ["grp"], "merkle-order")
                     .select("grp", "leaves", F.col("nth").alias("tree"), _levels(F.col("leaves")).alias("height")),
                     "merkle-groups")
    known = groups.select(F.col("grp").alias("_grp"), "leaves", "tree", "height")
    # by group and block of places: a large group's key is dealt out over its blocks
    known = known.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("leaves") - 1, BLOCK))))
    at = rows.grp.eqNullSafe(F.col("_grp")) & (F.shiftright("nth", BLOCK) == F.col("_block"))
    base = (rows.join(known, at).withColumnRenamed("leaves", "tree_leaves")
            .select("tree", "height", "nth", "node", "tree_leaves", *kept))

    tagged, inner, roots = _tree(base, ["tree_leaves", *kept], "merkle")
    tagged = _jump(tagged, inner, "merkle")
    height = _levels(F.lit(groups.count()).cast("long"))
    above = written(groups.drop("height").join(roots, "tree")
                    .select(F.lit(0).cast("long").alias("tree"), height.alias("height"), F.col("tree").alias("nth"), "node",
                            "leaves"), "merkle-above")
    top, top_inner, root = _tree(above, ["leaves"], "merkle-top")
    root = root.first()  # one row; none for an empty table
    top = _jump(top, top_inner, "merkle-top").select(
        F.col("nth").alias("tree"), "leaves", F.col("node").alias("subroot"), F.col("segs").alias("_more"),
        F.lit(bytes(root.node) if root else b"").alias("root"))
    out = _with_tree(tagged, written(top, "merkle-subroots"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(out_names, kept, strict=True)], F.col("node").alias("leaf"),
                      "subroot", "root", F.concat("segs", "_more").alias("proof"))


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root, as hex text, that a leaf and its proof lead to."""
    return F.expr(f"""aggregate({proof}, lower(hex({leaf})), (h, s) -> sha2(concat(
        lower(hex(substring(s.others, 1, 32 * s.slot))), h, lower(hex(substring(s.others, 32 * s.slot + 1)))), 256))""")


def proof_digest(proof: str = "proof") -> Column:
    """sha256 of all sibling digests, from the leaf's run up, as hex text."""
    return F.sha2(F.expr(f"aggregate({proof}, '', (a, s) -> concat(a, lower(hex(s.others))))"), 256)


def tamper_report(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, the root
    folded from the leaf of the tampered row with the original proof, and
    whether the two roots agree.

    Rows whose crc32 of the id is divisible by 3 are tampered: A-Z of the text
    in lower case; a null id or text is left as it is. Null fields count as
    ``-``; columns other than ``fields`` are not read.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    spoilt = digest_of(*[F.when(hit, lowered).otherwise(F.col(f)) if f == "text" else F.col(f) for f in fields])
    rows = docs.select("lang", "doc_id", leaf_digest(*fields).alias("leaf"), F.when(hit, spoilt).alias("spoilt"))
    out = proofs(rows, carry=("spoilt",)).withColumn("used", F.coalesce("spoilt", "leaf"))
    return (out.select("doc_id", as_hex("leaf").alias("leaf"), as_hex("subroot").alias("subroot"),
                       as_hex("root").alias("root"), proof_digest().alias("proof_sha256"),
                       folded("used").alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

"""Rows met on the way when each row points to a later one.

Greedy rules such as "fill a chunk, then start the next" or "fill a session,
then wait for the reset" say for every row where the next unit would begin if
one began there. The units that do begin are the rows reached from the first
one. A key's rows are cut into blocks of a fixed size. Within a block the way is
a fold over at most that many pointers. A key of several blocks first gets, for
each row, the pointer that leaves the row's block; the few rows that such
pointers lead to are joined with themselves, which doubles the step, until all
blocks are crossed. So no key is held in one task, and the rounds grow with the
logarithm of a key's blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from railyard.functions.scan import join_same
from railyard.session import materialized

BLOCK = 1024


def orbit(rows: DataFrame, key: list, idx: str = "idx", nxt: str = "next", block: int = BLOCK) -> DataFrame:
    """``key``, ``idx``, ``nxt`` and ``nth`` (from 0) of the rows reached from
    idx 0 of every key.

    ``rows`` should be materialised, as it is read more than once. Within a key
    idx runs from 0 without gaps; ``nxt`` is larger than ``idx``, and one that is
    null or beyond the last row ends the way. Null keys are equal.
    """
    slim = rows.select(*key, F.col(idx).cast("long").alias("__i"), F.col(nxt).cast("long").alias("__n"),
                       F.floor(F.col(idx) / F.lit(block)).cast("long").alias("__b"))
    blocks = slim.groupBy(*key, "__b").agg(F.array_sort(F.collect_list(F.struct("__i", "__n"))).alias("__rows"))
    if slim.filter("__b > 0").limit(1).count() == 0:
        walked = blocks.withColumn("__at", F.lit(0).cast("long")).withColumn("__before", F.lit(0).cast("long"))
        walked = walked.select(*key, "__before", F.expr(_WAY).alias("__got"))
    else:
        entries = _entries(slim, blocks, key, block)
        walked = join_same(blocks, entries, [*key, "__b"]).select(*key, "__b", F.expr(_WAY).alias("__got"))
        walked = walked.filter(F.size("__got") > 0)  # a pointer beyond the last row enters nothing
        w = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        counts = (walked.select(*key, "__b", F.size("__got").alias("__c"))
                  .select(*key, "__b", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__before")))  # a row per block
        walked = join_same(walked, counts, [*key, "__b"]).drop("__b")
    return (walked.select(*key, "__before", F.posexplode("__got").alias("__p", "__x"))
            .select(*key, F.col("__x.__i").alias(idx), F.col("__x.__n").alias(nxt),
                    (F.col("__p") + F.col("__before")).cast("long").alias("nth")))


#: The reached rows of a block: the fold waits for the row ``__at`` and then for the one it points to.
_WAY = """aggregate(__rows, struct(__at AS at, CAST(array() AS array<struct<__i: bigint, __n: bigint>>) AS got),
    (a, x) -> IF(x.__i = a.at, struct(x.__n AS at, concat(a.got, array(x)) AS got), a), a -> a.got)"""

#: For each row of a block, from the last to the first, the pointer that leaves the block.
_EXITS = """aggregate(reverse(__rows), CAST(array() AS array<bigint>), (a, x) -> concat(array(
    IF(x.__n > __rows[size(__rows) - 1].__i, x.__n, element_at(a, CAST(x.__n - x.__i AS int)))), a))"""


def _entries(slim: DataFrame, blocks: DataFrame, key: list, block: int) -> DataFrame:
    """(key, __b, __at): the first row reached in each block that the way enters."""
    # the first block of a key with more than one is full
    exits = materialized(
        blocks.filter((F.col("__b") > 0) | (F.size("__rows") == block))
        .select(*key, F.posexplode(F.expr(_EXITS)).alias("__p", "__to"), F.col("__rows")[0]["__i"].alias("__first"))
        .select(*key, (F.col("__first") + F.col("__p")).alias("__at"), "__to"), "orbit-exits")
    reached = slim.filter("__i = 0").select(*key, F.col("__i").alias("__at"))
    goals = exits.select(*key, F.col("__to").alias("__at")).union(reached).filter("__at IS NOT NULL").distinct()
    steps = materialized(join_same(exits, goals, [*key, "__at"])
                         .filter("__to IS NOT NULL"), "orbit-steps")
    while steps.limit(1).count():
        reached = materialized(reached.union(join_same(reached, steps, [*key, "__at"])
                                             .select(*key, F.col("__to").alias("__at"))), "orbit-reached")
        hop = steps.withColumnsRenamed({"__at": "__mid", "__to": "__far"}).withColumnRenamed("__mid", "__to")
        steps = materialized(join_same(steps, hop, [*key, "__to"])
                             .select(*key, "__at", F.col("__far").alias("__to")), "orbit-steps")
    return reached.select(*key, F.floor(F.col("__at") / F.lit(block)).cast("long").alias("__b"), "__at")

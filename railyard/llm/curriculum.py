"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unused, written

#: (weight at the start, weight at the end) per source rank, repeating; the
#: integral over the run of a linear schedule is the mean: 3, 1, 2.
SCHEDULE = ((4.0, 2.0), (1.0, 1.0), (1.0, 3.0))
_SOURCE = ["no_source", "src"]


def source_targets(sizes: DataFrame, schedule=SCHEDULE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source from (no_source, src, source_size): ``share`` of all
    sizes is dealt out by integrated weight, at most ``most`` times a source's
    size, and what exceeds that goes to the others by weight.

    In ascending order of cap / weight the sources fill up first; the level is
    the first at which the rest no longer overflows. One row per source.
    """
    rank = F.row_number().over(Window.orderBy(*_SOURCE)) - 1

    def pick(side: int) -> Column:
        return F.element_at(F.array(*[F.lit(float(w[side])) for w in schedule]),
                            (rank % len(schedule) + 1).cast("int"))

    ranked = (sizes.withColumn("w0", pick(0)).withColumn("w1", pick(1))
              .withColumn("weight", (F.col("w0") + F.col("w1")) / 2)
              .withColumn("cap", F.col("source_size") * F.lit(float(most)))
              .withColumn("fills_at", F.col("cap") / F.col("weight")))
    order = Window.orderBy("fills_at", *_SOURCE)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    return (ranked.withColumn("level", level)
            .withColumn("level", F.first(F.when(F.col("level") <= F.col("fills_at"), F.col("level")), True).over(
                order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .select(*_SOURCE, "source_size", "w0", "w1", "weight",
                    F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")))


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", schedule=SCHEDULE, share: float = 1.5,
                   most: float = 2.0, rows_per_bucket: int = 5_000) -> DataFrame:
    """One row per document, sorted by range of ``position``: doc_id, size,
    source_size, target, taken, position, text_key (a hash of the text).

    A source's documents stand in the order of md5(id). Whole passes over the
    source come first; the rest of its target goes to the documents from the
    front, the last of them in part, so a source's taken words equal its target
    rounded. ``position`` inverts the source's integrated schedule at the
    document's cumulative share: the training step, in words, at which its
    demand is reached; null if nothing is taken. Null ids order as the empty string, a null text has size
    0, a null source is a source of its own after all others; repeated rows
    count each. Sums are taken over buckets of the order first, so a hot source
    is spread over many tasks.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        key.alias("order_key"), F.xxhash64(text_col).alias("text_key")), "sized")
    buckets = max(1, math.ceil(sized.count() / rows_per_bucket))
    part = F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0 ** 32))
    sized = sized.withColumn("bucket", part.cast("int"))
    sums = sized.groupBy(*_SOURCE, "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy(*_SOURCE).agg(F.sum("bucket_size").alias("source_size")),
                             schedule, share, most)
    prior = F.sum("bucket_size").over(Window.partitionBy(*_SOURCE).orderBy("bucket")) - F.col("bucket_size")
    offsets = sums.withColumn("prior", prior).drop("bucket_size").join(targets, _SOURCE)
    inside = (Window.partitionBy(*_SOURCE, "bucket").orderBy("order_key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = (sized.join(offsets, [*_SOURCE, "bucket"])
            .withColumn("begin", F.col("prior") + F.sum("size").over(inside) - F.col("size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("passes", passes.cast("long"))
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("begin")))
    v = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("begin") / F.col("target"))).otherwise(0.0)
    root = F.sqrt(F.col("w0") * F.col("w0") + (F.col("w1") - F.col("w0")) * 2 * F.col("weight") * v)
    at = F.when(F.col("w0") + root > 0, F.col("weight") * 2 * v / (F.col("w0") + root)).otherwise(0.0)
    return (rows.withColumn("taken", F.col("passes") * F.col("size") + more)
            .withColumn("position", F.when(F.col("taken") > 0, at))
            .orderBy("position", "order_key", "doc_id", "size")
            .select("doc_id", "size", "source_size", "target", "taken", "position", "text_key"))


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, sorted by range of the
    copy's training position, with the columns of ``docs``.

    A document taken in part stays whole if at least half of it is taken.
    Repeated rows share what they take: each gets the mean, rounded up.
    """
    mix = curriculum_mix(docs, id_col, text_col, source_col, **how)
    whole = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1.0))
    own_id, key, copies, at, of, target, copy = unused(docs, "_id", "_key", "_copies", "_at", "_of", "_target", "_copy")
    picks = (mix.withColumn("copies", whole)
             .groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(key))
             .agg(F.ceil(F.avg("copies")).cast("int").alias(copies), F.min("position").alias(at),
                  F.min("source_size").alias(of), F.min("target").alias(target))
             .filter(F.col(copies) > 0))
    rows = docs.join(picks, docs[id_col].eqNullSafe(picks[own_id])
                     & (F.xxhash64(docs[text_col]) == picks[key]))
    nth = F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy)
    place = F.col(at) + F.when(F.col(target) > 0, F.col(copy) * F.col(of) / F.col(target)).otherwise(0.0)
    return rows.select(*docs.columns, at, of, target, nth).sort(place, F.col(id_col)).select(*docs.columns)

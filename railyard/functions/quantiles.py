"""Exact quantiles per group without buffering a group.

Equal values are counted first, so ties are one row. Counts by bin of a fixed
width say which bin holds a wanted rank; only the distinct values of those bins
are ranked one by one. The width decides how the work is spread, not the result.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from railyard.functions.scan import join_same


def exact_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float],
                    width: float = 2.0 ** -15) -> DataFrame:
    """One row per group: ``group`` and ``q0, q1, ...`` for ``probs``, with linear
    interpolation between neighbours. Null values are left out, null groups are
    one group, and a group without a value has no row."""
    counted = (df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("__v"))
               .agg(F.count("*").alias("__c")).withColumn("__bin", F.floor(F.col("__v") / F.lit(width))))
    so_far = Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (counted.groupBy(group, "__bin").agg(F.sum("__c").alias("__c"))  # a row per bin
            .withColumn("__before", F.coalesce(F.sum("__c").over(so_far), F.lit(0)))
            .withColumn("__n", F.sum("__c").over(Window.partitionBy(group))))
    ranks = []
    for i, p in enumerate(probs):
        at = (F.col("__n") - 1) * F.lit(float(p))
        ranks += [F.struct(F.lit(i).alias("i"), side.cast("long").alias("rank"), w.alias("w"))
                  for side, w in ((F.floor(at), 1 - (at - F.floor(at))), (F.floor(at) + 1, at - F.floor(at)))]
    # a neighbour of weight 0 is not needed and may not exist
    wanted = F.filter(F.array(*ranks), lambda r: (r["w"] > 0) & (r["rank"] >= F.col("__before"))
                      & (r["rank"] < F.col("__before") + F.col("__c")))
    bins = bins.select(group, "__bin", "__before", wanted.alias("__wanted")).filter(F.size("__wanted") > 0)
    inside = Window.partitionBy(group, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = (join_same(counted, bins, [group, "__bin"])
            .withColumn("__end", F.col("__before") + F.sum("__c").over(inside))
            .withColumn("__hit", F.explode("__wanted"))
            .filter((F.col("__hit.rank") < F.col("__end")) & (F.col("__hit.rank") >= F.col("__end") - F.col("__c"))))
    return near.groupBy(group).agg(*[
        F.sum(F.when(F.col("__hit.i") == i, F.col("__hit.w") * F.col("__v"))).alias(f"q{i}") for i in range(len(probs))])

"""Two-level running aggregates that split hot keys.

A window ``partitionBy(key).orderBy(t)`` puts a whole key into one task.
Here each key is cut into ordered buckets (a coarse function of the order
column, e.g. the hour of a timestamp).  Running aggregates are computed
inside each (key, bucket) in parallel; one row per (key, bucket) carries
its total, and a window over those bucket rows (small: one row per bucket)
gives each bucket the aggregate of all earlier buckets.  An equi-join on
(key, bucket), null-safe, adds that offset back.  Buckets must be non-decreasing in the
order, so rows tied in the order share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_AGG = {"sum": F.sum, "max": F.max, "count": F.count}


def join_same(left: DataFrame, right: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null, keeping the left keys: rows with
    a null key or a null order (hence bucket) find their group too."""
    names = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    cond = [left[k].eqNullSafe(r[n]) for k, n in names.items()]
    return left.join(r, cond, how).drop(*names.values())


def running(df: DataFrame, key: list, order: list, bucket: Column, aggs: dict,
            inclusive: bool = True) -> DataFrame:
    """Add running aggregates over ``key`` in ``order``.

    ``aggs``: ``{out_name: (kind, expr)}`` with kind ``sum`` / ``count`` /
    ``max``.  ``inclusive=False`` aggregates strictly earlier rows only.
    """
    b = "__bucket"
    df = df.withColumn(b, bucket)
    frame_end = 0 if inclusive else -1
    w_in = Window.partitionBy(*key, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    inner = {f"__in_{n}": _AGG[k](e).over(w_in) for n, (k, e) in aggs.items()}
    df = df.withColumns(inner)
    tot = df.groupBy(*key, b).agg(*[
        (F.count(e) if k == "count" else _AGG[k](e)).alias(f"__tot_{n}") for n, (k, e) in aggs.items()])
    w_b = Window.partitionBy(*key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*key, b, *[(F.sum if k in ("sum", "count") else F.max)(f"__tot_{n}").over(w_b)
                                .alias(f"__off_{n}") for n, (k, _e) in aggs.items()])
    df = join_same(df, tot, [*key, b])
    outs = {}
    for n, (k, _e) in aggs.items():
        inner_c, off = F.col(f"__in_{n}"), F.col(f"__off_{n}")
        if k in ("sum", "count"):
            outs[n] = F.coalesce(inner_c, F.lit(0)) + F.coalesce(off, F.lit(0))
        else:
            outs[n] = F.greatest(inner_c, off)
    drop = [b] + [f"__in_{n}" for n in aggs] + [f"__off_{n}" for n in aggs]
    return df.withColumns(outs).drop(*drop)


def previous(df: DataFrame, key: list, order: list, bucket: Column, col: str, out: str) -> DataFrame:
    """Value of ``col`` on the previous row of the key (``lag``), split the
    same way: inside a bucket it is the plain lag, on a bucket's first row it
    is the maximum of the earlier buckets (``col`` must grow with the order)."""
    b = "__pbucket"
    df = df.withColumn(b, bucket)
    w_in = Window.partitionBy(*key, b).orderBy(*order)
    df = df.withColumn("__lag", F.lag(col).over(w_in))
    tot = df.groupBy(*key, b).agg(F.max(col).alias("__bmax"))
    w_b = Window.partitionBy(*key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*key, b, F.max("__bmax").over(w_b).alias("__prev_b"))
    return (join_same(df, tot, [*key, b]).withColumn(out, F.coalesce("__lag", "__prev_b"))
            .drop(b, "__lag", "__prev_b"))


def hour_bucket(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(3_600_000_000)).cast("long")

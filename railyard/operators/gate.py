"""Relevance gate (G1-G4): best distance per query over the unfiltered corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from railyard.functions.quantiles import exact_quantiles
from railyard.functions.scan import join_same
from railyard.functions.vectors import norm
from railyard.operators.search import vector_topk_batch
from railyard.policy import DEFAULT_POLICY, Policy


def relevance_gate(queries: DataFrame, corpus: DataFrame, policy: Policy = DEFAULT_POLICY, *,
                   query_id: str = "query_id", query_vec: str = "embedding",
                   id_col: str = "id", vec_col: str = "embedding",
                   exclude_self: bool = False) -> DataFrame:
    """G1: one row per query: ``gate_allowed, best_distance, gate_reason``.

    * gate disabled                    -> allowed, "gate disabled"
    * query vector null / zero         -> allowed, "search error: ..." (fail open)
    * corpus empty (no hit)            -> refused, null distance, "no chunks returned"
    * best distance <= threshold       -> allowed
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("__qv"))
    if not policy.relevance_gate_enabled:
        return gate_from_hits(q, None, policy)
    hits = vector_topk_batch(corpus, q, 1, id_col=id_col, vec_col=vec_col,
                             query_id="query_id", query_vec="__qv",
                             exclude_self=exclude_self)
    return gate_from_hits(q, hits, policy)


def gate_from_hits(queries: DataFrame, hits, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The gate verdict from the rank-1 hit of an unfiltered search.

    ``queries``: ``query_id, __qv``; ``hits``: ``query_id, distance, rank``
    (any k >= 1, e.g. the retrieval search when it uses the same vector).
    """
    t = policy.distance_threshold
    tstr = repr(float(t))
    q = queries
    if not policy.relevance_gate_enabled:
        return q.select("query_id", F.lit(True).alias("gate_allowed"),
                        F.lit(None).cast("double").alias("best_distance"),
                        F.lit("gate disabled").alias("gate_reason"))
    best = hits.filter(F.col("rank") == 1).select("query_id", F.col("distance").alias("best_distance"),
                                                  F.lit(True).alias("__hit"))
    # one hit row per query: an equi-join on query_id, the corpus is not touched
    j = q.join(best, "query_id", "left")
    bad_vec = F.coalesce(norm("__qv") <= 0, F.lit(True))
    d = F.col("best_distance")
    fmt = F.format_string("%.4f", d)
    allowed = (F.when(bad_vec, F.lit(True))
               .when(F.col("__hit").isNull() | d.isNull(), F.lit(False))
               .otherwise(d <= F.lit(t)))
    reason = (F.when(bad_vec, F.lit("search error: invalid query vector"))
              .when(F.col("__hit").isNull() | d.isNull(), F.lit("no chunks returned"))
              .when(d > F.lit(t), F.concat(F.lit("best_distance "), fmt, F.lit(f" > threshold {tstr}")))
              .otherwise(F.concat(F.lit("best_distance "), fmt, F.lit(f" <= threshold {tstr}"))))
    return j.select("query_id", allowed.alias("gate_allowed"),
                    F.when(~bad_vec, d).alias("best_distance"), reason.alias("gate_reason"))


def gate_policy(gate: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Refuse only when the gate fails and refusal is switched on."""
    failed = ~F.col("gate_allowed")
    refuse = failed & F.lit(policy.refuse_when_no_context)
    return gate.withColumn(
        "refused_reason", F.when(refuse, F.lit("relevance_gate:out_of_scope"))
    ).withColumn("bypassed", failed & F.lit(not policy.refuse_when_no_context))


def gate_distance_probe(gate: DataFrame, group_col: str) -> DataFrame:
    """Distribution of best distances per group, regardless of verdict.
    Quantiles are exact, and no group is buffered."""
    d = F.col("best_distance")
    totals = gate.groupBy(group_col).agg(
        F.count("*").alias("n_queries"),
        F.count(d).alias("n_with_distance"),
        F.min(d).alias("min_distance"),
        F.max(d).alias("max_distance"),
    )
    mid = exact_quantiles(gate, group_col, "best_distance", (0.5, 0.9)).withColumnsRenamed(
        {"q0": "p50_distance", "q1": "p90_distance"})
    return join_same(totals, mid, [group_col], "left")


def gate_threshold_sweep(gate: DataFrame, on_topic: str, thresholds: list[float]) -> DataFrame:
    """False refusals / false passes per threshold and group overlap.

    Thresholds are a short parameter list: one aggregation computes every
    threshold as conditional sums (no join), then ``stack`` unpivots them.
    """
    d, on = F.col("best_distance"), F.col(on_topic)
    aggs = [F.max(F.when(on, d)).alias("max_on"), F.min(F.when(~on, d)).alias("min_off"),
            F.count(F.when(on, 1)).alias("n_on"), F.count(F.when(~on, 1)).alias("n_off")]
    for i, t in enumerate(thresholds):
        aggs.append(F.count(F.when(on & ~F.coalesce(d <= F.lit(t), F.lit(False)), 1)).alias(f"fr{i}"))
        aggs.append(F.count(F.when(~on & F.coalesce(d <= F.lit(t), F.lit(False)), 1)).alias(f"fp{i}"))
    wide = gate.agg(*aggs)
    stack = "stack({n}, {rows}) as (threshold, false_refusals, false_passes)".format(
        n=len(thresholds),
        rows=", ".join(f"cast({t!r} as double), fr{i}, fp{i}" for i, t in enumerate(thresholds)))
    return wide.selectExpr("n_on", "n_off", "max_on", "min_off", stack).select(
        "threshold", "false_refusals", "false_passes", "n_on", "n_off",
        F.coalesce(F.col("max_on") >= F.col("min_off"), F.lit(False)).alias("groups_overlap"))

"""Retrieval guards (H1-H10) over a long frame of search hits.

Input: one row per (query, chunk) with ``query_id, chunk_id, content,
distance, filename, file_type, token_count``.  Stages run in the order
empty -> metadata -> distance -> top_k -> token_budget; each later stage only
sees rows that survived the earlier ones.

One pass, one window: the rank among survivors is a running count of alive
rows and the token budget a running sum over survivors, both over the same
``partitionBy(query_id).orderBy(distance, chunk_id)`` frame, so Spark sorts
once and reuses the ``query_id`` partitioning left by the top-k search.
The running sum is exact for the "stop at the first overflow" rule because
token counts are non-negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from railyard.functions.text import is_blank
from railyard.policy import DEFAULT_POLICY, RETRIEVAL_STAGES, Policy


def _order_window(query_col: str):
    return (Window.partitionBy(query_col)
            .orderBy(F.col("distance").asc_nulls_last(), F.col("chunk_id").asc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def not_empty(content="content") -> Column:
    """H1: content is neither null nor whitespace-only."""
    return ~is_blank(content)


def allowlist_ok(policy: Policy = DEFAULT_POLICY, filename="filename", file_type="file_type") -> Column:
    """H2: filename allowlist when set (null filename fails); file-type allowlist
    compared case-insensitively unless empty (null type fails)."""
    ok = F.lit(True)
    if policy.filename_allowlist is not None:
        ok = ok & F.coalesce(F.col(filename).isin(*policy.filename_allowlist), F.lit(False))
    if policy.filetype_allowlist:
        allow = sorted({t.lower() for t in policy.filetype_allowlist})
        ok = ok & F.lower(F.coalesce(F.col(file_type), F.lit(""))).isin(*allow)
    return ok


def distance_ok(policy: Policy = DEFAULT_POLICY, distance="distance") -> Column:
    """H3: ``distance <= threshold``; a missing distance counts as infinity."""
    return F.coalesce(F.col(distance) <= F.lit(policy.distance_threshold), F.lit(False))


def cap_top_k(hits: DataFrame, k: int, query_col: str = "query_id") -> DataFrame:
    """H4: first k rows per query by (distance, chunk_id); k <= 0 = no cap."""
    if k <= 0:
        return hits
    w = Window.partitionBy(query_col).orderBy(F.col("distance").asc_nulls_last(), F.col("chunk_id").asc())
    return hits.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def token_budget(hits: DataFrame, budget: int, query_col: str = "query_id") -> DataFrame:
    """H5: greedy prefix that stops at the first chunk that would overflow."""
    run = F.sum("token_count").over(_order_window(query_col))
    return hits.withColumn("running_tokens", run).filter(F.col("running_tokens") <= budget)


def mark_stages(hits: DataFrame, policy: Policy = DEFAULT_POLICY, query_col: str = "query_id") -> DataFrame:
    """H6 (row level): adds ``stage`` = first failing stage (null = kept),
    ``survivor_rank`` and ``running_tokens`` for survivors."""
    w = _order_window(query_col)
    empty = ~not_empty("content")
    meta_bad = ~allowlist_ok(policy)
    dist_bad = ~distance_ok(policy)
    alive3 = ~empty & ~meta_bad & ~dist_bad
    df = hits.withColumn("__alive3", alive3)
    df = df.withColumn("survivor_rank", F.when(F.col("__alive3"),
                                               F.sum(F.col("__alive3").cast("int")).over(w)))
    topk_bad = F.lit(False) if policy.top_k <= 0 else (F.col("__alive3") & (F.col("survivor_rank") > policy.top_k))
    df = df.withColumn("__alive4", F.col("__alive3") & ~topk_bad)
    df = df.withColumn("running_tokens", F.when(F.col("__alive4"), F.sum(
        F.when(F.col("__alive4"), F.col("token_count")).otherwise(F.lit(0))).over(w)))
    budget_bad = F.col("__alive4") & (F.col("running_tokens") > policy.max_context_tokens)
    stage = (F.when(empty, F.lit("empty")).when(meta_bad, F.lit("metadata"))
             .when(dist_bad, F.lit("distance")).when(topk_bad, F.lit("top_k"))
             .when(budget_bad, F.lit("token_budget")))
    return df.withColumn("stage", stage).drop("__alive3", "__alive4")


def apply_retrieval_guards(hits: DataFrame, queries: DataFrame, policy: Policy = DEFAULT_POLICY,
                           query_col: str = "query_id") -> DataFrame:
    """H6: one row per query (queries without any hit included):
    ``chunks`` (array of surviving structs in distance order), ``chunk_ids``,
    ``no_context``, ``total_context_tokens``, ``dropped_counts`` (map) and one
    ``dropped_<stage>`` column per stage."""
    marked = mark_stages(hits, policy, query_col)
    kept = F.col("stage").isNull()
    chunk = F.struct(F.col("distance").alias("d"), F.col("chunk_id"), F.col("content"),
                     F.col("distance"), F.col("filename"), F.col("file_type"), F.col("token_count"))
    agg = marked.groupBy(query_col).agg(
        F.array_sort(F.collect_list(F.when(kept, chunk))).alias("__chunks"),
        F.sum(F.when(kept, F.col("token_count")).otherwise(0)).alias("total_context_tokens"),
        *[F.count(F.when(F.col("stage") == s, 1)).alias(f"dropped_{s}") for s in RETRIEVAL_STAGES])
    out = queries.select(query_col).distinct().join(agg, query_col, "left")
    chunks = F.transform(F.coalesce(F.col("__chunks"), F.array().cast(agg.schema["__chunks"].dataType)),
                         lambda c: c.dropFields("d"))
    fixed = {f"dropped_{s}": F.coalesce(F.col(f"dropped_{s}"), F.lit(0)).cast("long") for s in RETRIEVAL_STAGES}
    fixed["total_context_tokens"] = F.coalesce(F.col("total_context_tokens"), F.lit(0)).cast("long")
    fixed["chunks"] = chunks
    out = out.withColumns(fixed).drop("__chunks")
    return out.withColumns({
        "no_context": F.size("chunks") == 0,
        "chunk_ids": F.transform("chunks", lambda c: c["chunk_id"]),
        "dropped_counts": F.create_map(*[x for s in RETRIEVAL_STAGES for x in (F.lit(s), F.col(f"dropped_{s}"))])})


def format_context(guarded: DataFrame) -> DataFrame:
    """H7: JSON array of ``{chunk_id, content, filename, file_type, distance(4 dp)}``
    or the text ``NO_CONTEXT``.  Compact JSON; null fields are kept."""
    recs = F.transform("chunks", lambda c: F.struct(
        c["chunk_id"].alias("chunk_id"), c["content"].alias("content"), c["filename"].alias("filename"),
        c["file_type"].alias("file_type"), F.round(c["distance"], 4).alias("distance")))
    js = F.to_json(recs, {"ignoreNullFields": "false"})
    return guarded.withColumn("context", F.when(F.col("no_context"), F.lit("NO_CONTEXT")).otherwise(js))


def latest_retrieval(calls: DataFrame, turn_col: str = "turn_id", call_col: str = "call_no") -> DataFrame:
    """H9: only the last retrieval call of a turn defines the valid ids
    (replacement, not union)."""
    last = calls.groupBy(turn_col).agg(F.max(call_col).alias(call_col))
    return calls.join(last, [turn_col, call_col], "left_semi")


def guard_drop_report(guarded: DataFrame) -> DataFrame:
    """Total drops per stage over all queries."""
    stack = "stack({n}, {rows}) as (stage, dropped)".format(
        n=len(RETRIEVAL_STAGES),
        rows=", ".join(f"'{s}', dropped_{s}" for s in RETRIEVAL_STAGES))
    return (guarded.selectExpr(stack).groupBy("stage")
            .agg(F.sum("dropped").cast("long").alias("dropped")))

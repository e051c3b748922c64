"""Output guards over answers.

Answers: ``turn_id, answer, citations array<struct<chunk_id, source,
score>>, enough_context, needs_human`` (plus anything else).  Retrieved
chunks: a long frame ``turn_id, chunk_id, filename, distance``.

Citation checks are joins on ``(turn_id, chunk_id)`` between two frames
that are both bounded per turn; everything else is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from railyard.operators.scrub import scrub_pii, scrub_profanity_col
from railyard.policy import DEFAULT_POLICY, OUTPUT_STAGES, Policy

CITATION = "struct<chunk_id:string,source:string,score:double>"


def filter_citations(answers: DataFrame, retrieved: DataFrame, turn_col: str = "turn_id") -> DataFrame:
    """I1 (long form): keep citations whose chunk was retrieved in the same
    turn; ``dropped_citations`` lists the others in original order,
    duplicates kept.  Answers without citations keep empty arrays."""
    ids = retrieved.select(turn_col, "chunk_id").distinct().withColumn("__hit", F.lit(True))
    ex = answers.select(turn_col, F.posexplode("citations").alias("__pos", "__c"))
    j = ex.join(ids, [ex[turn_col] == ids[turn_col], F.col("__c.chunk_id") == ids["chunk_id"]], "left") \
        .select(ex[turn_col], "__pos", "__c", F.coalesce("__hit", F.lit(False)).alias("__hit"))
    agg = j.groupBy(turn_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("__hit"), F.struct("__pos", "__c")))).alias("__kept"),
        F.array_sort(F.collect_list(F.when(~F.col("__hit"), F.struct("__pos", F.col("__c.chunk_id").alias("id"))))).alias("__drop"))
    out = answers.join(agg, turn_col, "left")
    return (out.withColumn("citations", F.transform(F.coalesce("__kept", F.array()), lambda x: x["__c"]).cast(f"array<{CITATION}>"))
            .withColumn("dropped_citations", F.transform(F.coalesce("__drop", F.array()), lambda x: x["id"]).cast("array<string>"))
            .drop("__kept", "__drop"))


def filter_citations_inline(citations: Column, ids: Column) -> Column:
    """I1 (array form) when the retrieved ids are already on the row."""
    return F.filter(citations, lambda c: F.coalesce(F.array_contains(ids, c["chunk_id"]), F.lit(False)))


def check_citations_inline(answers: DataFrame, valid: DataFrame, turn_col: str = "turn_id") -> DataFrame:
    """I1 + I8 in array form: ``valid`` holds one row per turn with
    ``chunks`` (array of ``chunk_id, filename, distance``; bounded by the
    search k).  One equi-join on ``turn_id``, then row-local array
    functions: kept citations backfilled with source/score, dropped ids in
    order (duplicates kept)."""
    v = valid.select(turn_col, F.transform("chunks", lambda c: F.struct(
        c["chunk_id"].cast("string").alias("chunk_id"), c["filename"].alias("filename"),
        c["distance"].alias("distance"))).alias("__valid"))
    a = answers.join(v, turn_col, "left").withColumn(
        "__valid", F.coalesce("__valid", F.array().cast("array<struct<chunk_id:string,filename:string,distance:double>>")))

    def match(c):
        return F.filter("__valid", lambda x: x["chunk_id"] == c["chunk_id"])

    def has(c):
        return F.size(match(c)) > 0

    kept = F.filter("citations", has)
    back = F.transform(kept, lambda c: F.struct(
        c["chunk_id"].alias("chunk_id"), F.element_at(match(c), -1)["filename"].alias("source"),
        F.element_at(match(c), -1)["distance"].alias("score")))
    return (a.withColumn("dropped_citations", F.transform(F.filter("citations", lambda c: ~has(c)),
                                                          lambda c: c["chunk_id"]).cast("array<string>"))
            .withColumn("citations", back.cast(f"array<{CITATION}>"))
            .drop("__valid"))


def is_ungrounded(enough_context: Column, citations: Column) -> Column:
    """Claims enough context but no citation survived."""
    return enough_context & (F.coalesce(F.size(citations), F.lit(0)) == 0)


def apply_output_guards(filtered: DataFrame, policy: Policy = DEFAULT_POLICY,
                        answer_col: str = "answer") -> DataFrame:
    """I3 + I6 on the output of :func:`filter_citations`: grounding,
    suppression, PII scrub then profanity scrub (scrubs run even when the
    body is suppressed), ``final_body`` and ``flagged_stages`` in fixed order."""
    ung = is_ungrounded(F.col("enough_context"), F.col("citations"))
    df = filtered.withColumns({"ungrounded": ung, "body_suppressed": ~F.col("enough_context") | ung})
    df = scrub_pii(df, answer_col, "__pii_body", policy, count_prefix="pii_")
    masked, n_prof = scrub_profanity_col(F.col("__pii_body"), policy)
    df = df.withColumns({"scrubbed_answer": masked, "profanity_count": n_prof.cast("int")})
    stages = F.array_compact(F.array(
        F.when(F.size("dropped_citations") > 0, F.lit(OUTPUT_STAGES[0])),
        F.when(F.col("ungrounded"), F.lit(OUTPUT_STAGES[1])),
        F.when(F.col("body_suppressed") & ~F.col("enough_context"), F.lit(OUTPUT_STAGES[2])),
        F.when(F.size("pii_counts") > 0, F.lit(OUTPUT_STAGES[3])),
        F.when(F.col("profanity_count") > 0, F.lit(OUTPUT_STAGES[4]))))
    return df.withColumns({
        "flagged_stages": stages,
        "final_body": F.when(F.col("body_suppressed"), F.lit(policy.messages["offramp"])).otherwise(
            F.col("scrubbed_answer"))}).drop("__pii_body")


def retry_instruction(df: DataFrame, retrieved_count: str = "n_retrieved") -> DataFrame:
    """A grounding failure is retried with a different instruction:
    nothing retrieved this turn -> "retrieve", retrieved but mis-cited ->
    "reread"; other turns need no retry."""
    return df.withColumn("retry", F.when(F.col("ungrounded") & (F.coalesce(F.col(retrieved_count), F.lit(0)) == 0),
                                         F.lit("retrieve"))
                         .when(F.col("ungrounded"), F.lit("reread")))


def backfill_citations(answers: DataFrame, retrieved: DataFrame, turn_col: str = "turn_id") -> DataFrame:
    """I8: citation source = chunk filename, score = distance; unknown ids
    are left unchanged.  Of a chunk retrieved more than once in a turn the last
    call counts (``call_no``, if there is one), as in the router."""
    order = F.struct(*[c for c in ("call_no", "distance", "filename") if c in retrieved.columns])
    r = (retrieved.groupBy(turn_col, "chunk_id")
         .agg(F.max_by(F.struct("filename", "distance"), order).alias("__r")))
    ex = answers.select(turn_col, F.posexplode("citations").alias("__pos", "__c"))
    j = ex.join(r, [ex[turn_col] == r[turn_col], F.col("__c.chunk_id") == r["chunk_id"]], "left").select(
        ex[turn_col], "__pos",
        F.struct(F.col("__c.chunk_id").alias("chunk_id"),
                 F.when(F.col("__r").isNotNull(), F.col("__r.filename")).otherwise(F.col("__c.source")).alias("source"),
                 F.when(F.col("__r").isNotNull(), F.col("__r.distance")).otherwise(F.col("__c.score")).alias("score"))
        .alias("__c"))
    agg = j.groupBy(turn_col).agg(F.array_sort(F.collect_list(F.struct("__pos", "__c"))).alias("__l"))
    return (answers.drop("citations").join(agg, turn_col, "left")
            .withColumn("citations", F.transform(F.coalesce("__l", F.array()), lambda x: x["__c"]).cast(f"array<{CITATION}>"))
            .drop("__l"))


def group_citations(answers: DataFrame, turn_col: str = "turn_id") -> DataFrame:
    """Per answer, one row per source (else chunk id, else "unknown";
    empty strings count as missing) with count, best (lowest) score and
    order of first appearance."""
    ex = answers.select(turn_col, F.posexplode("citations").alias("pos", "c"))
    key = F.coalesce(F.nullif(F.col("c.source"), F.lit("")), F.nullif(F.col("c.chunk_id"), F.lit("")), F.lit("unknown"))
    g = ex.groupBy(turn_col, key.alias("source_key")).agg(
        F.count("*").alias("n_citations"), F.min("c.score").alias("best_score"), F.min("pos").alias("first_pos"))
    return g


# JS display clean-up of source names (fixed patterns).
PRETTY_PATTERNS = ((r"(?i)\.pdf\.pdf$", ".pdf"),
                   (r"^https?www\.[^.]+\.[a-z]{2,}[a-z]*?(?=[A-Z])", ""),
                   (r"^[/_\-\s]+", ""))


def pretty_source(name) -> Column:
    """Display name; falls back to the raw name when cleaning empties it."""
    n = F.col(name) if isinstance(name, str) else name
    s = n
    for p, r in PRETTY_PATTERNS:
        s = F.regexp_replace(s, p, r)
    return F.when(n.isNull() | (n == ""), F.lit("unknown source")).when(s == "", n).otherwise(s)

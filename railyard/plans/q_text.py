"""Registered input-guard and text queries (F1-F8, I4, I5, C4, C6, B9) over
``documents`` and ``conversations`` (whole tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions.text import approx_tokens, normalize_for_embedding
from railyard.operators import input_guards as IG
from railyard.operators import scrub as SC
from railyard.operators.conversation import session_id_from_conv, validate_turns
from railyard.plans import sqlfrag as Q
from railyard.plans.registry import register
from railyard.policy import DEFAULT_POLICY, PII_PATTERNS
from railyard.sources.tables import table

EVAL = Q.sql_evaluate_input("text")


def docs(spark, sf):
    return table(spark, sf, "documents")


@register("guard_length", sql=f"""
SELECT doc_id, {Q.sql_length_refused('text')} AS length_refused, {Q.sql_length_reason('text')} AS length_reason
FROM documents""")
def q_guard_length(spark, sf):
    """stripped length below 1 or raw length above 2000."""
    bad, reason = IG.length_check("text")
    return docs(spark, sf).select("doc_id", bad.alias("length_refused"), reason.alias("length_reason"))


@register("guard_language", sql="""
SELECT doc_id, lang, NOT coalesce(lower(lang) IN ('en'), FALSE) AS language_refused,
       TRUE AS stub_allowed FROM documents""")
def q_guard_language(spark, sf):
    """stub (always allow) and the opt-in allowlist on ``lang``."""
    bad, _ = IG.language_check(F.col("lang"), DEFAULT_POLICY.with_(enforce_language=True))
    stub, _ = IG.language_check(F.col("lang"), DEFAULT_POLICY)
    return docs(spark, sf).select("doc_id", "lang", bad.alias("language_refused"),
                                  (~stub).alias("stub_allowed"))


@register("guard_pii", sql=f"SELECT doc_id, {Q.sql_pii_label('text')} AS pii_label FROM documents")
def q_guard_pii(spark, sf):
    """first PII label per document."""
    return docs(spark, sf).select("doc_id", IG.pii_label("text").alias("pii_label"))


@register("guard_jailbreak", sql=f"""
SELECT conv_id, turn, {Q.sql_jailbreak_idx('text')} AS jailbreak_pattern FROM conversations
UNION ALL
SELECT doc_id AS conv_id, -1 AS turn, {Q.sql_jailbreak_idx('text')} AS jailbreak_pattern FROM documents""")
def q_guard_jailbreak(spark, sf):
    """first injection pattern per message (conversations) and document."""
    conv = table(spark, sf, "conversations").select(
        "conv_id", "turn", IG.jailbreak_index("text").alias("jailbreak_pattern"))
    d = docs(spark, sf).select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
                               IG.jailbreak_index("text").alias("jailbreak_pattern"))
    return conv.unionByName(d)


@register("guard_profanity", sql=f"""
SELECT doc_id, array_to_string({Q.sql_profanity_hits('text')}, ',') AS profanity_hits,
       len({Q.sql_profanity_hits('text')}) > 0 AS flagged FROM documents""")
def q_guard_profanity(spark, sf):
    """sorted word-list hits among stripped whitespace tokens."""
    h = IG.profanity_hits("text")
    return docs(spark, sf).select("doc_id", F.array_join(h, ",").alias("profanity_hits"),
                                  (F.size(h) > 0).alias("flagged"))


@register("evaluate_input", sql=f"""
SELECT doc_id, {EVAL['allowed']} AS input_allowed, {EVAL['category']} AS input_category,
       {EVAL['reason']} AS input_reason, {EVAL['flagged']} AS input_flagged FROM documents""")
def q_evaluate_input(spark, sf):
    """ordered input guards over every document."""
    return IG.evaluate_input(docs(spark, sf).select("doc_id", "text"), "text").drop("text")


@register("evaluate_input_turns", sql=f"""
SELECT conv_id, turn, {EVAL['allowed']} AS input_allowed, {EVAL['category']} AS input_category,
       {EVAL['reason']} AS input_reason, {EVAL['flagged']} AS input_flagged
FROM conversations WHERE role = 'user'""")
def q_evaluate_input_turns(spark, sf):
    """F6 over every user message of every conversation."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    return IG.evaluate_input(c, "text").drop("text")


def _refusal_sql():
    m = DEFAULT_POLICY.messages
    return (f"CASE WHEN {EVAL['allowed']} THEN '' "
            f"WHEN {EVAL['category']} = 'length' AND contains({EVAL['reason']}, 'below') THEN {Q.q(m['length_short'])} "
            f"WHEN {EVAL['category']} = 'length' THEN {Q.q(m['length_long'])} "
            f"WHEN {EVAL['category']} = 'pii' THEN {Q.q(m['pii'])} "
            f"WHEN {EVAL['category']} = 'jailbreak' THEN {Q.q(m['jailbreak'])} "
            f"ELSE {Q.q(m['other'])} END")


@register("refusal_message", sql=f"SELECT doc_id, {_refusal_sql()} AS refusal_message FROM documents")
def q_refusal_message(spark, sf):
    """canned refusal text per decision."""
    d = IG.evaluate_input(docs(spark, sf).select("doc_id", "text"), "text")
    return d.select("doc_id", IG.refusal_message(F.col("input_allowed"), F.col("input_category"),
                                                 F.col("input_reason")).alias("refusal_message"))


@register("guard_hit_report", sql=f"""
SELECT coalesce(category, 'none') AS category, allowed, reason, count(*) AS n FROM (
  SELECT {EVAL['category']} AS category, {EVAL['allowed']} AS allowed, {EVAL['reason']} AS reason
  FROM documents) GROUP BY ALL""")
def q_guard_hit_report(spark, sf):
    """F8: decision counts by category and reason."""
    return IG.guard_hit_report(IG.evaluate_input(docs(spark, sf).select("text"), "text"))


_SCRUB_TXT, _SCRUB_COUNTS = Q.sql_pii_scrub("text")


@register("scrub_pii", sql=f"""
SELECT doc_id, {_SCRUB_TXT} AS scrubbed, {', '.join(f'{c} AS n_{label}' for label, c in _SCRUB_COUNTS)}
FROM documents""")
def q_scrub_pii(spark, sf):
    """I4: sequential PII redaction with per-label counts."""
    out = SC.scrub_pii(docs(spark, sf).select("doc_id", "text"), "text")
    return out.select("doc_id", "scrubbed", *[f"n_{label}" for label, _ in PII_PATTERNS])


_MASK_TXT, _MASK_N = Q.sql_profanity_mask("text")


@register("scrub_profanity", sql=f"""
SELECT doc_id, {_MASK_TXT} AS masked, {_MASK_N} AS profanity_count FROM documents""")
def q_scrub_profanity(spark, sf):
    """Equal-length masks on whole word tokens."""
    out = SC.scrub_profanity(docs(spark, sf).select("doc_id", "text"), "text")
    return out.select("doc_id", "masked", "profanity_count")


@register("token_counts", sql="""
SELECT doc_id, greatest(1, floor(length(coalesce(text, '')) / 4))::BIGINT AS tokens FROM documents""")
def q_token_counts(spark, sf):
    """C4: fallback token count max(1, len // 4)."""
    return docs(spark, sf).select("doc_id", approx_tokens("text").alias("tokens"))


@register("normalize_for_embedding", sql="""
SELECT doc_id, replace(text, chr(10), ' ') AS normalized FROM documents""")
def q_normalize(spark, sf):
    """Newline to blank."""
    return docs(spark, sf).select("doc_id", normalize_for_embedding("text").alias("normalized"))


_SID_SQL = """CASE conv_id % 4
      WHEN 0 THEN md5(CAST(conv_id AS VARCHAR))
      WHEN 1 THEN regexp_replace(md5(CAST(conv_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')
      WHEN 2 THEN '{' || regexp_replace(md5(CAST(conv_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') || '}'
      ELSE 'conv-' || CAST(conv_id AS VARCHAR) END"""


@register("validate_turns", sql=f"""
WITH t AS (SELECT conv_id, turn, {_SID_SQL} AS session_id, text FROM conversations WHERE role = 'user'),
v AS (SELECT *, replace(trim(replace(replace(session_id, 'urn:', ''), 'uuid:', ''), '{{}}'), '-', '') AS h FROM t)
SELECT conv_id, turn, session_id,
       (length(h) = 32 AND regexp_matches(h, '^[0-9A-Fa-f]+$')) AND NOT (length({Q.sql_ustrip('text')}) = 0) AS valid,
       CASE WHEN NOT (length(h) = 32 AND regexp_matches(h, '^[0-9A-Fa-f]+$')) THEN 'session_id must be a valid UUID'
            WHEN length({Q.sql_ustrip('text')}) = 0 THEN 'message must not be empty or whitespace-only' END AS reject_reason
FROM v""")
def q_validate_turns(spark, sf):
    """Session id must parse as a UUID, message must not be blank."""
    c = (table(spark, sf, "conversations").filter(F.col("role") == "user")
         .select("conv_id", "turn", session_id_from_conv("conv_id").alias("session_id"),
                 F.col("text").alias("message")))
    return validate_turns(c).select("conv_id", "turn", "session_id", "valid", "reject_reason")

"""Input guards (F1-F8) as one projection over a message column.

Order: length -> language -> pii -> jailbreak -> profanity.  The verdict is a
single ``CASE WHEN`` chain, so for a row refused by an early guard the later
regexes are never evaluated, and no guard needs a join or a Python UDF.
Patterns are literals; Catalyst compiles each one once per task. Where a cheap
condition tells that a pattern cannot match (``functions.regex_gate``), it is not
run at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from railyard.functions.regex_gate import has_digit, lowered, may_match
from railyard.functions.text import quoted_list, ustrip, ws_tokens
from railyard.policy import DEFAULT_POLICY, ESCALATION_KEYWORDS, PROFANITY_STRIP_CHARS, Policy


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_pii(p: str) -> str:
    """Python's ``\\b \\d \\s \\w`` are Unicode; Java needs ``(?U)``."""
    return "(?U)" + p


def java_jailbreak(p: str) -> str:
    return "(?iU)" + p


def length_check(msg, policy: Policy = DEFAULT_POLICY):
    """(refused, reason) – stripped length below min, raw length above max."""
    m = F.coalesce(_c(msg), F.lit(""))
    short = F.length(ustrip(m)) < F.lit(policy.min_input_chars)
    long_ = F.length(m) > F.lit(policy.max_input_chars)
    reason = (F.when(short, F.lit(f"input below min_input_chars ({policy.min_input_chars})"))
              .when(long_, F.lit(f"input above max_input_chars ({policy.max_input_chars})")))
    return short | long_, reason


def language_check(lang, policy: Policy = DEFAULT_POLICY):
    """the reference's stub allows everything; opt in to an allowlist."""
    if not policy.enforce_language or lang is None:
        return F.lit(False), F.lit(None).cast("string")
    bad = ~F.coalesce(F.lower(_c(lang)).isin(*policy.allowed_languages), F.lit(False))
    return bad, F.when(bad, F.concat(F.lit("language not allowed: "),
                                     F.coalesce(_c(lang), F.lit("unknown"))))


def pii_label(msg, policy: Policy = DEFAULT_POLICY, digit: Column | None = None) -> Column:
    """first matching PII label in policy order, else null. ``digit``: whether
    the message holds a digit, if that is known."""
    if not policy.block_pii_in_input:
        return F.lit(None).cast("string")
    m = _c(msg)
    return F.coalesce(*[F.when(may_match(p, m, digit=digit) & m.rlike(java_pii(p)), F.lit(label))
                        for label, p in policy.pii_patterns])


def jailbreak_index(msg, policy: Policy = DEFAULT_POLICY, low: Column | None = None) -> Column:
    """1-based index of the first matching injection pattern, else null.
    ``low``: the message as :func:`lowered` gives it, if that is at hand."""
    if not policy.block_jailbreak_attempts:
        return F.lit(None).cast("int")
    m = _c(msg)
    return F.coalesce(*[F.when(may_match(p, low=low) & m.rlike(java_jailbreak(p)), F.lit(i + 1))
                        for i, p in enumerate(policy.jailbreak_patterns)])


def jailbreak_reason(idx: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return F.element_at(F.array(*[F.lit(f"jailbreak pattern matched: {p!r}")
                                  for p in policy.jailbreak_patterns]), idx)


def profanity_hits(msg, policy: Policy = DEFAULT_POLICY) -> Column:
    """sorted distinct word-list hits among whitespace tokens stripped of
    ``.,!?;:"'()[]`` and lower-cased."""
    if not policy.profanity_words:
        return F.array().cast("array<string>")
    toks = F.transform(ws_tokens(F.coalesce(_c(msg), F.lit(""))),
                       lambda t: F.lower(F.btrim(t, F.lit(PROFANITY_STRIP_CHARS))))
    words = F.array(*[F.lit(w.lower()) for w in policy.profanity_words])
    return F.array_sort(F.array_intersect(toks, words))


def evaluate_input(df: DataFrame, msg: str = "message", policy: Policy = DEFAULT_POLICY,
                   lang: str | None = None, prefix: str = "input_") -> DataFrame:
    """first refusal wins, else first flag, else clean allow.

    Adds ``{prefix}allowed, {prefix}category, {prefix}reason, {prefix}flagged``.
    Each finding is a column of its own, made only for rows that no earlier guard
    refuses, so no pattern runs twice on a row.
    """
    t = {k: f"__{prefix}{k}" for k in ("msg", "low", "digit", "len", "lang", "pii", "jb", "hits", "decision")}
    m = F.col(t["msg"])
    len_bad, len_reason = length_check(m, policy)
    lang_bad, lang_reason = language_check(F.col(lang) if lang else None, policy)
    df = df.withColumn(t["msg"], F.coalesce(F.col(msg), F.lit("")))
    df = df.withColumns({t["len"]: len_reason, t["lang"]: lang_reason, t["low"]: lowered(m), t["digit"]: has_digit(m)})
    len_reason, lang_reason = F.col(t["len"]), F.col(t["lang"])
    open_ = len_reason.isNull() & lang_reason.isNull()
    df = df.withColumn(t["pii"], F.when(open_, pii_label(m, policy, F.col(t["digit"]))))
    pii = F.col(t["pii"])
    df = df.withColumn(t["jb"], F.when(open_ & pii.isNull(), jailbreak_index(m, policy, F.col(t["low"]))))
    jb = F.col(t["jb"])
    df = df.withColumn(t["hits"], F.when(open_ & pii.isNull() & jb.isNull(), profanity_hits(m, policy)))
    hits = F.col(t["hits"])
    len_bad, lang_bad = len_reason.isNotNull(), lang_reason.isNotNull()

    def dec(allowed, cat, reason, flagged):
        return F.struct(F.lit(allowed).alias("allowed"), F.lit(cat).cast("string").alias("category")
                        if isinstance(cat, (str, type(None))) else cat.alias("category"),
                        reason.cast("string").alias("reason"), F.lit(flagged).alias("flagged"))

    decision = (F.when(len_bad, dec(False, "length", len_reason, False))
                .when(lang_bad, dec(False, "language", lang_reason, False))
                .when(pii.isNotNull(), dec(False, "pii", F.concat(F.lit("pii pattern matched: "), pii), False))
                .when(jb.isNotNull(), dec(False, "jailbreak", jailbreak_reason(jb, policy), False))
                .when(F.size(hits) > 0, dec(True, "profanity",
                                            F.concat(F.lit("profanity tokens flagged: "), quoted_list(hits)), True))
                .otherwise(dec(True, None, F.lit(None), False)))
    return (df.withColumn(t["decision"], decision)
            .withColumns({f"{prefix}{k}": F.col(f"{t['decision']}.{k}") for k in ("allowed", "category", "reason", "flagged")})
            .drop(*t.values()))


def refusal_message(allowed: Column, category: Column, reason: Column,
                    policy: Policy = DEFAULT_POLICY) -> Column:
    """canned text per category; length splits on the word "below"."""
    msgs = policy.messages
    return (F.when(allowed, F.lit(""))
            .when((category == "length") & F.coalesce(reason.contains("below"), F.lit(False)),
                  F.lit(msgs["length_short"]))
            .when(category == "length", F.lit(msgs["length_long"]))
            .when(category == "language", F.lit(msgs["language"]))
            .when(category == "pii", F.lit(msgs["pii"]))
            .when(category == "jailbreak", F.lit(msgs["jailbreak"]))
            .otherwise(F.lit(msgs["other"])))


def guard_hit_report(decisions: DataFrame, prefix: str = "input_") -> DataFrame:
    """F8: counts by category and reason (map-side partial aggregation)."""
    return (decisions.groupBy(F.coalesce(F.col(f"{prefix}category"), F.lit("none")).alias("category"),
                              F.col(f"{prefix}allowed").alias("allowed"),
                              F.col(f"{prefix}reason").alias("reason"))
            .agg(F.count("*").alias("n")))


def mentions_human(msg) -> Column:
    """Lower, ``?`` and ``,`` to blanks, whitespace split, keyword overlap.
    "person." does not match (punctuation other than ``?,`` stays attached)."""
    toks = ws_tokens(F.translate(F.lower(F.coalesce(_c(msg), F.lit(""))), "?,", "  "))
    return F.arrays_overlap(toks, F.array(*[F.lit(w) for w in ESCALATION_KEYWORDS])) & (F.size(toks) > 0)

"""Output text scrubs (I4, I5): PII redaction and profanity masking.

Both work on literal patterns: JVM-only, one projection, no UDF. A text is
split once per PII label; the pieces give the count and the scrubbed text.
Profanity words have fixed lengths, so the equal-length mask is a literal per word.
Texts that cannot match a pattern (``functions.regex_gate``) are not searched for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from railyard.functions.regex_gate import has_digit, may_match
from railyard.operators.input_guards import java_pii
from railyard.policy import DEFAULT_POLICY, REDACTED, Policy


def scrub_pii(df: DataFrame, text: str, out: str = "scrubbed", policy: Policy = DEFAULT_POLICY,
              count_prefix: str = "n_") -> DataFrame:
    """I4: replace hits with ``[redacted]`` label by label, in order; each
    count is taken on the text already scrubbed by earlier labels.

    Adds ``out``, one ``{count_prefix}{label}`` column per label and
    ``pii_counts`` (map of non-zero counts).
    """
    cur = "__pii0"
    df = df.withColumn(cur, F.col(text))
    if not policy.scrub_pii_in_output:
        df = df.withColumn(out, F.col(cur))
        for label, _ in policy.pii_patterns:
            df = df.withColumn(f"{count_prefix}{label}", F.lit(0).cast("int"))
        return df.withColumn("pii_counts", F.create_map().cast("map<string,int>")).drop(cur)
    df = df.withColumn("__digit", has_digit(F.col(cur)))  # a replacement adds no digit
    for i, (label, p) in enumerate(policy.pii_patterns):
        pat, now = java_pii(p), F.col(cur)
        pieces, nxt = f"__pieces{i}", f"__pii{i + 1}"
        df = df.withColumn(pieces, F.when(may_match(p, now, digit=F.col("__digit")), F.split(now, pat, -1))
                           .when(now.isNotNull(), F.array(now))).drop(cur)
        df = df.withColumns({f"{count_prefix}{label}": F.coalesce(F.array_size(pieces) - 1, F.lit(0)),
                             nxt: F.array_join(pieces, REDACTED)}).drop(pieces)
        cur = nxt
    counts = F.map_filter(F.create_map(*[x for label, _ in policy.pii_patterns
                                         for x in (F.lit(label), F.col(f"{count_prefix}{label}"))]),
                          lambda k, v: v > 0)
    return df.withColumnRenamed(cur, out).withColumn("pii_counts", counts).drop("__digit")


def profanity_pattern(word: str) -> str:
    return r"(?iU)\b" + word + r"\b"


def scrub_profanity_col(text: Column, policy: Policy = DEFAULT_POLICY) -> tuple[Column, Column]:
    """(masked text, number of masked tokens).  Whole ``\\w+`` tokens whose
    lower case is a listed word become ``*`` of the same length."""
    if not policy.scrub_profanity_in_output or not policy.profanity_words:
        return text, F.lit(0)
    masked, count = text, F.lit(0)
    for w in sorted(set(x.lower() for x in policy.profanity_words)):
        p = profanity_pattern(w)
        count = count + F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
        masked = F.regexp_replace(masked, p, "*" * len(w))
    return masked, count


def scrub_profanity(df: DataFrame, text: str, out: str = "masked",
                    policy: Policy = DEFAULT_POLICY) -> DataFrame:
    masked, count = scrub_profanity_col(F.col(text), policy)
    return df.withColumn(out, masked).withColumn("profanity_count", count.cast("int"))

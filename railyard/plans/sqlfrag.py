"""DuckDB (RE2) fragments used by the oracle SQL.

These are an independent statement of the same rules in another engine:
RE2 has no lookahead and ASCII ``\\b``/``\\w``, so two rules are rewritten
(see ``JAILBREAK_RE2`` and ``sql_profanity_mask``).
"""

from __future__ import annotations

from railyard.policy import (DEFAULT_POLICY, JAILBREAK_PATTERNS, PII_PATTERNS,
                             PROFANITY_STRIP_CHARS, REDACTED, WS_CLASS, Policy)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# Pattern 5 without the lookahead: "you are now" followed by whitespace that
# does not continue as "a helpful" (backtracking makes two blanks enough).
_P5 = (r"you\s+are\s+now\s(\s|$|[^a\s]|a($|[^\s]|\s+($|[^\sh]|h($|[^e]|e($|[^l]|l($|[^p]"
       r"|p($|[^f]|f($|[^u]|u($|[^l])))))))))")
JAILBREAK_RE2 = tuple(_P5 if "(?!" in p else p for p in JAILBREAK_PATTERNS)


def sql_ustrip(e: str) -> str:
    return f"regexp_replace({e}, {q(rf'\A{WS_CLASS}+|{WS_CLASS}+\z')}, '', 'g')"


def sql_tokens(e: str) -> str:
    s = sql_ustrip(e)
    return (f"(CASE WHEN length({s}) = 0 THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array({s}, {q(WS_CLASS + '+')}) END)")


def sql_length_refused(e: str, p: Policy = DEFAULT_POLICY) -> str:
    return f"(length({sql_ustrip(e)}) < {p.min_input_chars} OR length({e}) > {p.max_input_chars})"


def sql_length_reason(e: str, p: Policy = DEFAULT_POLICY) -> str:
    return (f"(CASE WHEN length({sql_ustrip(e)}) < {p.min_input_chars} "
            f"THEN {q(f'input below min_input_chars ({p.min_input_chars})')} "
            f"WHEN length({e}) > {p.max_input_chars} "
            f"THEN {q(f'input above max_input_chars ({p.max_input_chars})')} END)")


def sql_pii_label(e: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({e}, {q(p)}) THEN {q(label)}"
                               for label, p in PII_PATTERNS) + " END)"


def sql_jailbreak_idx(e: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({e}, {q(p)}, 'i') THEN {i + 1}"
                               for i, p in enumerate(JAILBREAK_RE2)) + " END)"


def sql_jailbreak_reason(idx: str) -> str:
    arr = "[" + ", ".join(q(f"jailbreak pattern matched: {p!r}") for p in JAILBREAK_PATTERNS) + "]"
    return f"({arr})[{idx}]"


def sql_profanity_hits(e: str, p: Policy = DEFAULT_POLICY) -> str:
    words = "[" + ", ".join(q(w) for w in p.profanity_words) + "]"
    toks = f"list_transform({sql_tokens(e)}, lambda t: lower(trim(t, {q(PROFANITY_STRIP_CHARS)})))"
    return f"list_sort(list_distinct(list_filter({toks}, lambda t: list_contains({words}, t))))"


def sql_quoted_list(arr: str) -> str:
    return f"('[' || array_to_string(list_transform({arr}, lambda x: '''' || x || ''''), ', ') || ']')"


def sql_evaluate_input(e: str, p: Policy = DEFAULT_POLICY) -> dict[str, str]:
    """allowed / category / reason / flagged as four SQL expressions."""
    hits = sql_profanity_hits(e, p)
    pii = sql_pii_label(e)
    jb = sql_jailbreak_idx(e)
    ln = sql_length_refused(e, p)
    cat = (f"(CASE WHEN {ln} THEN 'length' WHEN {pii} IS NOT NULL THEN 'pii' "
           f"WHEN {jb} IS NOT NULL THEN 'jailbreak' WHEN len({hits}) > 0 THEN 'profanity' END)")
    reason = (f"(CASE WHEN {ln} THEN {sql_length_reason(e, p)} "
              f"WHEN {pii} IS NOT NULL THEN 'pii pattern matched: ' || {pii} "
              f"WHEN {jb} IS NOT NULL THEN {sql_jailbreak_reason(jb)} "
              f"WHEN len({hits}) > 0 THEN 'profanity tokens flagged: ' || {sql_quoted_list(hits)} END)")
    allowed = f"(NOT ({ln} OR {pii} IS NOT NULL OR {jb} IS NOT NULL))"
    flagged = f"({allowed} AND len({hits}) > 0)"
    return {"allowed": allowed, "category": cat, "reason": reason, "flagged": flagged}


def sql_pii_scrub(e: str) -> tuple[str, list[tuple[str, str]]]:
    """(scrubbed text, [(label, count expr on the progressively scrubbed text)])."""
    counts = []
    cur = e
    for label, p in PII_PATTERNS:
        counts.append((label, f"len(regexp_extract_all({cur}, {q(p)}))"))
        cur = f"regexp_replace({cur}, {q(p)}, {q(REDACTED)}, 'g')"
    return cur, counts


# Unicode word characters (Python's \w) for RE2, which only has ASCII \w.
_W = r"[\pL\pM\pN_]"
_NW = r"[^\pL\pM\pN_]"


def sql_profanity_mask(e: str, p: Policy = DEFAULT_POLICY) -> tuple[str, str]:
    """(masked text, count).  Boundaries are written as explicit non-word
    characters; two passes cover neighbours that share one boundary."""
    masked = e
    for w in sorted(set(x.lower() for x in p.profanity_words)):
        pat = q(f"(^|{_NW}){w}({_NW}|$)")
        rep = q("\\1" + "*" * len(w) + "\\2")
        for _ in range(2):
            masked = f"regexp_replace({masked}, {pat}, {rep}, 'gi')"
    words = "[" + ", ".join(q(w) for w in p.profanity_words) + "]"
    count = (f"len(list_filter(regexp_split_to_array(lower({e}), {q(_NW + '+')}), "
             f"lambda t: list_contains({words}, t)))")
    return masked, count

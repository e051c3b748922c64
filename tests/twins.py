"""Plain-Python statements of the rules, written from their semantics, used
as brute-force references on small fixtures."""

from __future__ import annotations

import re

from railyard.policy import JAILBREAK_PATTERNS, PII_PATTERNS, PROFANITY_STRIP_CHARS, PROFANITY_WORDS

PII = [(label, re.compile(p)) for label, p in PII_PATTERNS]
JB = [re.compile(p, re.IGNORECASE) for p in JAILBREAK_PATTERNS]
WORDS = frozenset(PROFANITY_WORDS)
KEYWORDS = frozenset({"human", "agent", "representative", "manager", "supervisor", "person"})


def evaluate(m: str, lo: int = 1, hi: int = 2000):
    if len(m.strip()) < lo:
        return (False, "length", f"input below min_input_chars ({lo})", False)
    if len(m) > hi:
        return (False, "length", f"input above max_input_chars ({hi})", False)
    for label, p in PII:
        if p.search(m):
            return (False, "pii", f"pii pattern matched: {label}", False)
    for p in JB:
        if p.search(m):
            return (False, "jailbreak", f"jailbreak pattern matched: {p.pattern!r}", False)
    hits = {t.strip(PROFANITY_STRIP_CHARS).lower() for t in m.split()} & WORDS
    if hits:
        return (True, "profanity", f"profanity tokens flagged: {sorted(hits)}", True)
    return (True, None, None, False)


def scrub_pii(t: str):
    counts = {}
    for label, p in PII:
        t, n = p.subn("[redacted]", t)
        if n:
            counts[label] = n
    return t, counts


def scrub_profanity(t: str):
    n = 0

    def mask(m):
        nonlocal n
        tok = m.group(0)
        if tok.lower() in WORDS:
            n += 1
            return "*" * len(tok)
        return tok

    return re.sub(r"\b\w+\b", mask, t), n


def mentions_human(m: str) -> bool:
    return bool(set(m.lower().replace("?", " ").replace(",", " ").split()) & KEYWORDS)


def retrieval_guards(rows, *, k, threshold, budget, fn_allow, ft_allow):
    """rows: dicts with chunk_id, content, distance, filename, file_type, token_count."""
    rows = sorted(rows, key=lambda r: (float("inf") if r["distance"] is None else r["distance"], r["chunk_id"]))
    dropped = {}
    kept = [r for r in rows if r["content"] and r["content"].strip()]
    dropped["empty"] = len(rows) - len(kept)
    rows = kept
    kept = []
    for r in rows:
        if fn_allow is not None and (r["filename"] is None or r["filename"] not in fn_allow):
            continue
        if ft_allow and (r["file_type"] or "").lower() not in ft_allow:
            continue
        kept.append(r)
    dropped["metadata"] = len(rows) - len(kept)
    rows = kept
    kept = [r for r in rows if r["distance"] is not None and r["distance"] <= threshold]
    dropped["distance"] = len(rows) - len(kept)
    rows = kept
    if k > 0 and len(rows) > k:
        dropped["top_k"] = len(rows) - k
        rows = rows[:k]
    else:
        dropped["top_k"] = 0
    kept, used = [], 0
    for r in rows:
        if used + r["token_count"] > budget:
            break
        kept.append(r)
        used += r["token_count"]
    dropped["token_budget"] = len(rows) - len(kept)
    return [r["chunk_id"] for r in kept], used, dropped


def session_fold(turns, ttl_us, cap, per_turn, trim):
    """turns: (t_us, input_ok, eligible) in order -> capped flags."""
    last, stored, out = None, 0, []
    for t, ok, el in turns:
        if stored > 0 and t - last >= ttl_us:
            stored = 0
        if not ok:
            out.append(False)
            continue
        if stored >= cap:
            out.append(True)
            continue
        out.append(False)
        if el:
            stored = min(stored + per_turn, trim)
            last = t
    return out


def cache_replay(times, ttl_us):
    exp, out = None, []
    for t in times:
        if exp is None or t >= exp:
            out.append(False)
            exp = t + ttl_us
        else:
            out.append(True)
    return out


def pack(tokens, limit):
    """Greedy packing of token counts (each <= limit) -> chunk number per block."""
    out, s, c = [], 0, 0
    for i, t in enumerate(tokens):
        if s + t > limit and s > 0:
            c += 1
            s = 0
        s += t
        out.append(c)
    return out

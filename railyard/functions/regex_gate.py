"""Cheap conditions that a text must meet before a pattern can match it.

A plain substring search or one look for a digit is far faster than a regular
expression, and most texts match none of a policy's patterns. What a pattern
cannot do without is read from the pattern itself, so it holds for any policy.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as C, _parser
from typing import Optional

from pyspark.sql import Column, functions as F

#: Letters outside ASCII that a case-insensitive Unicode pattern takes for s, i, i and k.
FOLDED, PLAIN = "ſıİK", "siik"


@lru_cache(maxsize=256)
def required(pattern: str) -> tuple[Optional[str], bool, bool]:
    """(longest literal that every match holds or None, whether every match holds
    a digit, whether the pattern itself ignores case). A pattern that Python
    cannot parse requires nothing."""
    runs, digit = [""], False

    def walk(items) -> None:
        nonlocal digit
        for op, av in items:
            if op is C.LITERAL and 32 <= av < 127:
                runs[-1] += chr(av)
            elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
                pass  # takes up no character
            elif op is C.SUBPATTERN and not av[1] and not av[2]:
                walk(av[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                runs.append("")
                if av[0] >= 1:
                    walk(av[2])
                runs.append("")
            else:
                digit = digit or (op is C.IN and list(av) in ([(C.CATEGORY, C.CATEGORY_DIGIT)], [(C.RANGE, (48, 57))]))
                runs.append("")

    try:
        tree = _parser.parse(pattern)
        walk(tree)
    except (re.error, RecursionError):
        return None, False, True
    return max(runs, key=len) or None, digit, bool(tree.state.flags & re.IGNORECASE)


def lowered(text: Column) -> Column:
    """The text as :func:`may_match` wants it for case-insensitive patterns."""
    return F.lower(F.translate(text, FOLDED, PLAIN))


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def may_match(pattern: str, text: Optional[Column] = None, low: Optional[Column] = None,
              digit: Optional[Column] = None) -> Column:
    """False only where ``pattern`` cannot match. ``text``: the text itself, for a
    pattern that minds case; ``low``: :func:`lowered` of it, for one that does
    not; ``digit``: :func:`has_digit` of it or of a text that holds it."""
    literal, needs_digit, ignores_case = required(pattern)
    out = F.lit(True)
    if needs_digit and digit is not None:
        out = out & digit
    if literal and low is not None:
        out = out & low.contains(literal.lower())
    elif literal and text is not None and not ignores_case:
        out = out & text.contains(literal)
    return out

"""Column helpers for text: Unicode strip/split, token counts, normalisation.

All helpers return JVM Column expressions, so callers keep whole-stage codegen;
only a token counter that the user supplies runs in Python, on Arrow batches.
"""

from __future__ import annotations

from typing import Callable, Optional, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from railyard.policy import WS_CLASS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ustrip(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), rf"\A{WS_CLASS}+|{WS_CLASS}+\z", "")


def is_blank(col) -> Column:
    """True for null, empty or whitespace-only text."""
    return F.coalesce(F.length(ustrip(col)) == 0, F.lit(True))


def ws_tokens(col) -> Column:
    """Python ``str.split()``: tokens between runs of Unicode whitespace."""
    s = ustrip(col)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(
        F.split(s, WS_CLASS + "+"))


def approx_tokens(col) -> Column:
    """Documented fallback token count ``max(1, len // 4)``."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(_c(col), F.lit(""))) / 4)).cast("long")


#: Token counts of a batch of texts, e.g. ``lambda texts: [len(e.ids) for e in tok.encode_batch(texts)]``.
Counter = Optional[Callable[[Sequence[str]], Sequence[int]]]


def token_count(col, counter: Counter = None) -> Column:
    """Tokens of a text by ``counter``, or by :func:`approx_tokens`. A count below
    1 is 1, as with the default rule; null counts as the empty text."""
    if counter is None:
        return approx_tokens(col)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(["" if t is None else t for t in texts]), dtype="int64").clip(lower=1)

    return count(_c(col))


def normalize_for_embedding(col) -> Column:
    """Newline to blank before embedding (carriage returns are kept)."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def quoted_list(arr: Column) -> Column:
    """Render an array<string> like Python's ``repr(list_of_str)``."""
    return F.concat(F.lit("["), F.array_join(
        F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def ts_text(col) -> Column:
    """Timestamp as fixed text ``yyyy-MM-dd HH:mm:ss.SSSSSS`` (stable across engines)."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss.SSSSSS")

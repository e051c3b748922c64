"""Metadata projections and filters.

Metadata is a ``map<string,string>`` (or JSON text parsed with
``from_json``).  Filters compile to one Column so Catalyst can push the
parts on real columns down to the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Union

from pyspark.sql import Column, DataFrame, functions as F


def parse_metadata(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, "map<string,string>")


def expand_metadata(df: DataFrame, keys: list[str], metadata_col: str = "metadata",
                    id_col: str = "id", json: bool = False) -> DataFrame:
    """B1: metadata keys become top-level columns, the map is dropped and the
    id is cast to string."""
    m = parse_metadata(metadata_col) if json else F.col(metadata_col)
    out = df.withColumn("__m", m)
    for k in keys:
        out = out.withColumn(k, F.element_at(F.col("__m"), F.lit(k)))
    return out.drop("__m", metadata_col).withColumn(id_col, F.col(id_col).cast("string"))


def metadata_text(value) -> str:
    """A value as metadata text holds it: by JSON's rules (true, not True)."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def filter_metadata(metadata: Column, flt: Union[dict, list]) -> Column:
    """B2: equality on every key of a dict; a list of dicts matches if any does."""
    dicts = flt if isinstance(flt, list) else [flt]

    def has(k: str, v) -> Column:
        held = F.element_at(metadata, F.lit(k))
        if v is None:  # the key is there and its value is null
            return F.coalesce(F.map_contains_key(metadata, F.lit(k)), F.lit(False)) & held.isNull()
        return F.coalesce(held == F.lit(metadata_text(v)), F.lit(False))

    def one(d: dict) -> Column:
        return reduce(lambda a, b: a & b, [has(k, v) for k, v in d.items()])

    return reduce(lambda a, b: a | b, [one(d) for d in dicts])


@dataclass(frozen=True)
class Pred:
    """B3 predicate tree: ``Pred('k', '>', 5) & Pred('t', '==', 'x') | ...``.

    A missing key never matches (also for ``!=``); numeric values compare
    the metadata text as double; text that is no number never matches."""
    key: str = ""
    op: str = "=="
    value: object = None
    kids: tuple = ()
    kind: str = "leaf"

    def __and__(self, other):
        return Pred(kind="and", kids=(self, other))

    def __or__(self, other):
        return Pred(kind="or", kids=(self, other))

    def column(self, metadata: Column) -> Column:
        if self.kind == "and":
            return self.kids[0].column(metadata) & self.kids[1].column(metadata)
        if self.kind == "or":
            return self.kids[0].column(metadata) | self.kids[1].column(metadata)
        raw = F.element_at(metadata, F.lit(self.key))
        if isinstance(self.value, (int, float)) and not isinstance(self.value, bool):
            v, lit = raw.try_cast("double"), F.lit(float(self.value))
        else:
            v, lit = raw, F.lit(metadata_text(self.value))
        ops = {"==": v == lit, "!=": v != lit, ">": v > lit, ">=": v >= lit, "<": v < lit, "<=": v <= lit}
        if self.op not in ops:
            raise ValueError(f"unknown operator {self.op}")
        return F.coalesce(ops[self.op], F.lit(False))


def filter_time_range(ts: Column, start: str, end: str, ts_type: str = "timestamp_ntz") -> Column:
    """Start inclusive, end exclusive."""
    return (ts >= F.lit(start).cast(ts_type)) & (ts < F.lit(end).cast(ts_type))


# UUID version 1: 100 ns ticks since 1582-10-15.
_UUID_EPOCH_TICKS = 122192928000000000


def uuid1_timestamp(u) -> Column:
    """The time carried by a version-1 UUID (microsecond precision)."""
    c = F.lower(F.col(u) if isinstance(u, str) else u)
    hexts = F.concat(F.substring(c, 16, 3), F.substring(c, 10, 4), F.substring(c, 1, 8))
    ticks = F.conv(hexts, 16, 10).cast("decimal(20,0)")
    micros = F.floor((ticks - F.lit(_UUID_EPOCH_TICKS)) / 10).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def uuid1_from_time(ts, clock_seq, node) -> Column:
    """Version-1 UUID text for a timestamp (inverse of B5), with the given
    14-bit clock sequence and 48-bit node."""
    c = F.col(ts) if isinstance(ts, str) else ts
    ticks = F.unix_micros(c.cast("timestamp")) * 10 + F.lit(_UUID_EPOCH_TICKS)
    low = F.format_string("%08x", ticks.bitwiseAND(F.lit(0xFFFFFFFF)))
    mid = F.format_string("%04x", F.shiftright(ticks, 32).bitwiseAND(F.lit(0xFFFF)))
    hi = F.format_string("%04x", F.shiftright(ticks, 48).bitwiseAND(F.lit(0x0FFF)).bitwiseOR(F.lit(0x1000)))
    cs = F.format_string("%04x", (F.col(clock_seq) if isinstance(clock_seq, str) else clock_seq)
                         .bitwiseAND(F.lit(0x3FFF)).bitwiseOR(F.lit(0x8000)))
    nd = F.format_string("%012x", (F.col(node) if isinstance(node, str) else node).bitwiseAND(F.lit(0xFFFFFFFFFFFF)))
    return F.concat_ws("-", low, mid, hi, cs, nd)


def compose_faq_record(df: DataFrame, question: str = "question", answer: str = "answer",
                       category: str = "category", created_at: str = "created_at",
                       keep: tuple = ()) -> DataFrame:
    """Contents ``"Question: q\\nAnswer: a"``, metadata with category and
    ISO-8601 creation time."""
    iso = F.date_format(F.col(created_at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(
        *keep,
        F.concat(F.lit("Question: "), F.col(question), F.lit("\nAnswer: "), F.col(answer)).alias("contents"),
        F.create_map(F.lit("category"), F.col(category), F.lit("created_at"), iso).alias("metadata"),
        F.col(created_at))

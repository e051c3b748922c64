"""Chat formatting with loss masks aligned by token offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role NEWLINE text CLOSE. Inside roles and texts, every
#: character of a control string that opens one is written as an escape, so no
#: control string can occur there.
OPEN, CLOSE, INST, INST_END = "<s>", "</s>", "[INST] ", " [/INST]"
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_ROLE_ESCAPES = str.maketrans(_ESCAPES | {"\n": "\\n"})
_TEXT_ESCAPES = str.maketrans(_ESCAPES)
_TURN = re.compile(r"<s>([^\n<]*)\n(?:\[INST\] ([^<\[]*) \[/INST\]|([^<\[]*))</s>")


def escape(text: str) -> str:
    return text.translate(_TEXT_ESCAPES)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the texts to learn."""
    out, at, spans = [], 0, []
    for role, text in turns:
        body = escape(text)
        before = OPEN + role.translate(_ROLE_ESCAPES) + "\n" + (INST if role == "user" else "")
        after = (INST_END if role == "user" else "") + CLOSE
        if role == learn and body:
            spans.append((at + len(before), at + len(before) + len(body)))
        out += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of ``render``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])))
        at = m.end()
    return turns


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, begin, end) by token: the part of a token inside a span, if any.

    Spans are sorted and apart, so the first span that ends after a token's
    start, found by binary search, is the first that can touch it. Tokens that
    share a character (pieces of one code point) count it once. A token that
    reaches over several short spans is cut to each of them.
    """
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.asarray(spans, np.int64)
    begin = np.maximum(offsets[:, 0], np.concatenate([[0], np.maximum.accumulate(offsets[:-1, 1])]))
    first = np.searchsorted(edges[:, 1], begin, "right")
    last = np.searchsorted(edges[:, 0], offsets[:, 1], "left")
    times = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(offsets)), times)
    span = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    a, b = np.maximum(begin[token], edges[span, 0]), np.minimum(offsets[token, 1], edges[span, 1])
    keep = a < b
    own_first = np.searchsorted(edges[:, 1], offsets[:, 0], "right")
    return last > own_first, a[keep], b[keep]


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def format_conversations(turns: DataFrame, tokenizer_path: str, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, input_ids, loss_mask (by token), loss_begin and
    loss_end (code points of the formatted text) of whole conversations.

    Turns stand in the order of turn, then role and text; null turns come
    first, a null role or text is empty, null ids form one conversation,
    repeated rows stay. A conversation is one sample and so one row; different
    conversations are spread over the tasks. Columns other than conv_id, turn,
    role and text are ignored.
    """
    rows = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = dict(grouped.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [render([(t["role"], t["text"]) for t in c], learn) for c in part.column(1).to_pylist()]
                codes = tok.encode_batch([f for f, _ in done], add_special_tokens=False)
                masks = [token_mask(np.asarray(e.offsets, np.int64).reshape(-1, 2), s)
                         for e, (_, s) in zip(codes, done, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f for f, _ in done]),
                     pa.array([e.ids for e in codes], pa.list_(pa.int32())),
                     pa.array([m[0] for m in masks], pa.list_(pa.bool_())),
                     pa.array([m[1] for m in masks], pa.list_(pa.int64())),
                     pa.array([m[2] for m in masks], pa.list_(pa.int64()))],
                    ["conv_id", "formatted", "input_ids", "loss_mask", "loss_begin", "loss_end"])

    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, input_ids array<int>, "
                                   "loss_mask array<boolean>, loss_begin array<long>, loss_end array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_tokens and n_loss_tokens, all from the formatted output alone."""
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            rows = []
            for r in part.to_pylist():
                text, turns = r["formatted"], parse(r["formatted"])
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = unescape("".join(text[a:b] for a, b in zip(r["loss_begin"], r["loss_end"], strict=True)))
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text),
                             len(r["input_ids"]), sum(r["loss_mask"])))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
                 "n_tokens", "n_loss_tokens"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")

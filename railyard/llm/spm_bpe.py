"""Byte-level BPE by a sentencepiece model that is written from the vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache

#: Each byte as one character that no normalisation touches.
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]
_MAPPED = {b: BYTE_CHARS[b] for b in range(256)}
_BPE, _UNKNOWN, _NORMAL = 2, 2, 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAPPED)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in order of rank, score the negative
    rank, an unknown piece after the last, identity normalisation, and neither
    a dummy prefix nor any white-space rule."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must count up from 0")
    out = bytearray()
    for rank, token in enumerate(order):
        piece = _field(1, mapped(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, _NORMAL)
        out += _field(1, piece)
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, _UNKNOWN))
    trainer = _number(3, _BPE) + _number(4, len(order) + 1) + _number(40, len(order))
    normal = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normal)


class SpmByteBpe:
    """encode(texts) -> little-endian uint32 ids; decode(ids) -> bytes."""

    def __init__(self, rank_path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_path)
        self.table = sorted(self.ranks, key=self.ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids by pre-token
        self.cache = ChunkCache(self._chunks)

    def _cut(self, chunk: str) -> list[str]:
        """The pattern's matches; letters and a tail of stops need no search."""
        word = chunk.rstrip(".,")
        if word.removeprefix(" ").isalpha():
            return [word] if len(word) == len(chunk) else [word, chunk[len(word):]]
        return self.split(chunk)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        cut = list(map(self._cut, chunks))
        known = self.known
        if len(known) > 200_000:
            known.clear()
        new = list(set(chain.from_iterable(cut)).difference(known))
        data = [p.encode() for p in new]
        whole = [self.ranks.get(d) for d in data]
        # a pre-token that is a token itself is taken whole, as ranks demand
        merge = [d.decode("latin-1").translate(_MAPPED) for d, r in zip(data, whole, strict=True) if r is None]
        ids = iter(self.model.encode(merge, out_type=int, num_threads=1))
        known.update((p, array("I", next(ids) if r is None else (r,)).tobytes())
                     for p, r in zip(new, whole, strict=True))
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.many(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=1)
def shared_bpe(rank_path: str, pattern: str) -> SpmByteBpe:
    """One encoder per Python worker, so that later tasks find its caches filled."""
    return SpmByteBpe(rank_path, pattern)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    with ``keep_ids`` ids (binary, little-endian uint32).

    Every whole text is encoded and its ids are decoded again; the digests are
    taken in the task. Null is empty; rows are independent of each other, other
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(cols.dtypes)["doc_id"]
    return cols.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                                + ", ids binary" * keep_ids)

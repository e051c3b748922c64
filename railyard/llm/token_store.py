"""Token-id files: an adaptive context-mixing range coder over blocks of ids, whose
lanes are coded side by side."""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ChunkCache, written

MAGIC = b"ctxids2\0"
BLOCK, LANES = 1024, 4096      # ids in a lane; lanes of a block, coded side by side
_IDS, _SLOTS = 1 << 16, 1 << 17  # predictions kept of order 1 and of order 2
_WAYS, _STEP, _AGED = 1 << 12, 24, 1 << 22  # scale, step and limit of the mixing counts
_REBUILD, _GAIN, _FULL = 32, 32, 1 << 22    # of the order-0 frequencies
_LEAST, _TOP = 1 << 32, 1 << 48  # bounds of a lane's range
_ID, _SURE = 0xFFFF, 0x10000   # a prediction is its id and, above it, its confidence


class _Model:
    """The state of a block, reset at its start, so blocks decode independently.
    The lanes of a block walk side by side and learn from one another.

    Order 2 and order 1 each predict one id from the last ids, with a
    confidence of 0 to 3. Counts per pair of confidences mix them: what share
    order 2 and order 1 deserve, and what goes to the order-0 model, which
    codes the id by adaptive frequencies whose cumulative sums are renewed
    every few steps.
    """

    def __init__(self):
        self.two, self.one = np.zeros(_SLOTS, np.int32), np.zeros(_IDS, np.int32)
        sure2, sure1 = np.divmod(np.arange(32) % 16, 4)
        self.ways = np.stack([8 * sure2 + 1, 4 * sure1 + 1, np.full(32, 8)], 1)
        self.freq, self.seen = np.ones(_IDS, np.int64), []
        self.mix()
        self.renew()

    def mix(self) -> None:
        """Shares of the three ways of each cell, in parts of _WAYS and at least one."""
        total = self.ways.sum(1, keepdims=True)
        if (total > _AGED).any():
            self.ways = np.where(total > _AGED, (self.ways + 1) >> 1, self.ways)
            total = self.ways.sum(1, keepdims=True)
        share = self.ways * (_WAYS - 3) // total + 1
        share[:, 2] = _WAYS - share[:, 0] - share[:, 1]
        self.way_freq = share.ravel()
        self.way_start = (np.cumsum(share, 1) - share).ravel()

    def renew(self) -> None:
        if self.seen:
            self.freq += _GAIN * np.bincount(np.concatenate(self.seen), minlength=_IDS)
            self.seen = []
        while self.freq.sum() > _FULL:
            self.freq = (self.freq + 1) >> 1
        self.sums = np.zeros(_IDS + 1, np.int64)
        np.cumsum(self.freq, out=self.sums[1:])
        self.total = int(self.sums[-1])
        # the id at the begin of each of up to 65536 even parts of the sums
        self.shift = max(0, self.total.bit_length() - 16)
        part = (self.sums[:-1] + (1 << self.shift) - 1) >> self.shift
        inside = int(np.searchsorted(part, (self.total - 1 >> self.shift) + 1))
        first = np.zeros((self.total - 1 >> self.shift) + 1, np.int64)
        first[part[:inside]] = np.arange(inside)
        self.first = np.maximum.accumulate(first)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose cumulative intervals hold the values."""
        ids = self.first[value >> self.shift]
        on = np.flatnonzero(self.sums[ids + 1] <= value)
        ids[on] = np.searchsorted(self.sums, value[on], "right") - 1
        return ids

    @staticmethod
    def learn(table: np.ndarray, slot: np.ndarray, was: np.ndarray, p: np.ndarray, x: np.ndarray, miss: np.ndarray) -> None:
        """A hit is surer, a miss costs the confidence or, if that is low, the id."""
        table[slot] = np.where(miss, np.where(was >= 2 * _SURE, p, x) | _SURE, np.minimum(was + _SURE, p | 3 * _SURE))


class _Encoder:
    """Range coder with 48-bit low and range per lane. Words of 16 bits and
    carries into the word before are noted in the order of their steps."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.int64), np.full(n, _TOP - 1, np.int64)
        self.who: list[np.ndarray] = []
        self.word: list[np.ndarray] = []

    def note(self, who: np.ndarray, word: np.ndarray) -> None:
        self.who.append(who.astype(np.uint16))
        self.word.append(word.astype(np.int32))

    def put(self, rows, lanes, start, freq, r) -> None:
        low, wide = self.low[rows] + start * r, r * freq
        over = np.flatnonzero(low >= _TOP)
        if len(over):
            self.note(lanes[over], np.full(len(over), -1))
            low[over] -= _TOP
        thin = np.flatnonzero(wide < _LEAST)
        while len(thin):
            self.note(lanes[thin], low[thin] >> 32)
            low[thin] = (low[thin] & 0xFFFFFFFF) << 16
            wide[thin] <<= 16
            thin = thin[wide[thin] < _LEAST]
        self.low[rows], self.range[rows] = low, wide

    def words(self) -> np.ndarray:
        """The first three words of every lane, then the others in the order in
        which the decoder, three words ahead, asks for them."""
        n = len(self.low)
        for shift in (32, 16, 0):
            self.note(np.arange(n), self.low >> shift & 0xFFFF)
        who, word = np.concatenate(self.who), np.concatenate(self.word)
        place = np.cumsum(word >= 0, dtype=np.int32) - 1
        order = np.argsort(who, kind="stable")
        who, word, place = who[order], word[order], place[order]
        real = word >= 0
        before = np.cumsum(real)[~real] - 1  # the words that carries go into
        who, word, place = who[real], word[real], place[real]
        np.add.at(word, before, 1)
        while len(over := np.flatnonzero(word > 0xFFFF)):
            word[over] -= 0x10000
            word[over - 1] += 1
        early = np.zeros(len(who), bool)
        early[np.searchsorted(who, np.arange(n, dtype=np.uint16))[:, None] + np.arange(3)] = True
        out = np.empty(len(word), "<u2")
        out[:3 * n] = word[early]
        late = np.flatnonzero(~early)
        out[3 * n + place[late - 3]] = word[late]
        return out


class _Decoder:
    def __init__(self, n: int, words: np.ndarray):
        if len(words) < 3 * n:
            raise ValueError("a block is too short")
        self.words, self.at = words.astype(np.int64), 3 * n
        first = self.words[:3 * n].reshape(n, 3)
        self.code = first[:, 0] << 32 | first[:, 1] << 16 | first[:, 2]
        self.range = np.full(n, _TOP - 1, np.int64)

    def take(self, rows, start, freq, r) -> None:
        code, wide = self.code[rows] - start * r, r * freq
        thin = np.flatnonzero(wide < _LEAST)
        while len(thin):
            got = self.words[self.at:self.at + len(thin)]
            if len(got) < len(thin):
                raise ValueError("a block is too short")
            self.at += len(thin)
            code[thin] = code[thin] << 16 | got
            wide[thin] <<= 16
            thin = thin[wide[thin] < _LEAST]
        self.code[rows], self.range[rows] = code, wide


def _run(n: int, length: int, last: int, ids: np.ndarray | None, words: np.ndarray | None) -> np.ndarray:
    """Encode ``ids`` (length x lanes, int32) or decode ``words`` to such a table;
    the last of the n lanes holds ``last`` ids only."""
    model, lanes = _Model(), np.arange(n)
    enc = _Encoder(n) if words is None else None
    dec = _Decoder(n, words) if words is not None else None
    out = ids if ids is not None else np.zeros((length, n), np.int32)
    one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(length):
        live = n if t < last else n - 1
        rows = slice(0, live)
        if t < 16 or t % 4 == 0:
            model.mix()
        if t and (t % _REBUILD == 0 or (t < _REBUILD and t & (t - 1) == 0)):
            model.renew()
        s1 = one[rows]
        s2 = (s1 * 0x9E3779B1 + two[rows] * 0x85EBCA6B >> 13) & (_SLOTS - 1)
        e2, e1 = model.two[s2], model.one[s1]
        p2, p1 = e2 & _ID, e1 & _ID
        cell = (3 * ((e2 >> 16 << 2) + (e1 >> 16) + ((p1 == p2).view(np.int8) << 4))).astype(np.int64)
        coder = enc or dec
        r = coder.range[rows] >> 12
        if enc:
            x = out[t, :live]
            miss2, miss1 = x != p2, x != p1
            cell += miss2 * (1 + miss1.view(np.int8))
            enc.put(rows, lanes, model.way_start[cell], model.way_freq[cell], r)
            rare = np.flatnonzero(miss2 & miss1)
        else:
            code = dec.code[rows]
            other, rest = code >= model.way_start[cell + 1] * r, code >= model.way_start[cell + 2] * r
            cell += other
            cell += rest
            dec.take(rows, model.way_start[cell], model.way_freq[cell], r)
            x = np.where(other, p1, p2)
            rare = np.flatnonzero(rest)
        if len(rare):
            r = coder.range[rare] // model.total
            if dec:
                x[rare] = model.find(np.minimum((dec.code[rare] / r).astype(np.int64), model.total - 1))
            new = x[rare].astype(np.int64)
            start = model.sums[new]
            freq = model.sums[new + 1] - start
            (enc.put(rare, rare, start, freq, r) if enc else dec.take(rare, start, freq, r))
            model.seen.append(new)
        if dec:
            miss2, miss1 = x != p2, x != p1
            out[t, :live] = x
        model.ways += _STEP * np.bincount(cell, minlength=96).reshape(32, 3)
        model.learn(model.two, s2, e2, p2, x, miss2)
        model.learn(model.one, s1, e1, p1, x, miss1)
        two[rows] = s1
        one[rows] = x
    if enc:
        return enc.words()
    if dec.at != len(words) or dec.code.any():  # a whole block is read to its last bit
        raise ValueError("a block is damaged")
    return out


def _lanes(count: int) -> tuple[int, int, int]:
    """Lanes of a block of so many ids, their length, and the length of the last."""
    length = max(64, -(-count // LANES))
    n = -(-count // length)
    return n, length if n > 1 else count, count - (n - 1) * length


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A frame: magic, count of ids, ids in a lane, count of blocks; per block
    its words, the crc32 of its ids and that of its words; then the coded blocks. Ids below 65536."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and ids.max() > _ID:
        raise ValueError("ids of more than 16 bits")
    head, body = [], []
    for at in range(0, len(ids), block * LANES):
        part = ids[at:at + block * LANES]
        n, length, last = _lanes(len(part))
        table = np.zeros(n * length, np.int32)
        table[:len(part)] = part
        body.append(_run(n, length, last, np.ascontiguousarray(table.reshape(n, length).T), None).tobytes())
        head.append(zlib.crc32(part))
    index = b"".join(struct.pack("<III", len(b) // 2, c, zlib.crc32(b)) for b, c in zip(body, head, strict=True))
    return MAGIC + struct.pack("<QII", len(ids), block, len(body)) + index + b"".join(body)


def decode_ids(frame: bytes) -> np.ndarray:
    """The ids of a frame; ValueError if a block's checksum does not hold."""
    if frame[:8] != MAGIC:
        raise ValueError("no id frame")
    count, block, n = struct.unpack_from("<QII", frame, 8)
    index = np.frombuffer(frame, "<u4", 3 * n, 24).reshape(n, 3)
    ends = 24 + 12 * n + 2 * np.cumsum(index[:, 0], dtype=np.int64)
    out = np.zeros(count, "<u4")
    for i in range(n):
        part = out[i * block * LANES:(i + 1) * block * LANES]
        words = np.frombuffer(frame, "<u2", int(index[i, 0]), int(ends[i]) - 2 * int(index[i, 0]))
        if zlib.crc32(words) != index[i, 2]:
            raise ValueError(f"block {i} is damaged")
        lanes, length, last = _lanes(len(part))
        part[:] = _run(lanes, length, last, None, words).T.reshape(-1)[:len(part)]
        if zlib.crc32(part) != index[i, 1]:
            raise ValueError(f"block {i} gave other ids")
    return out


#: What keeps a text from being cut at every single space and newline: white space that
#: str.split knows but for these two, and either of them at an edge or beside another.
_ODD = (r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
        r"|\A[ \n]|[ \n][ \n]|[ \n]\z")

#: A stop between a letter and white space or the end is a token of its own, too.
_STOP, _LETTER = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", string.ascii_letters.encode()))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, at least ``n`` long; what is added is zero."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class _TextIds:
    """Ids of texts by chunks as in ChunkCache, but cut and numbered by numpy and
    Arrow a batch at a time; each chunk that is not known yet is encoded once.

    Chunks of a space and a word are encoded a hundred in one text, as its
    spaces are token boundaries, and told apart by the bytes of the tokens. At
    ``limit`` chunks, those that came in one batch only are forgotten.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.pieces = ChunkCache(None).pieces
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token)  # a sign stands for a byte
        for i, token in self.tok.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self.known: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size, self.came = (np.zeros(1 << 16, t) for t in (np.int64, np.int64, np.int8))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes], words: bool) -> None:
        joined = [c for c in chunks if words and c[0] == 32]
        alone = [c for c in chunks if not (words and c[0] == 32)]
        groups = [joined[i:i + 100] for i in range(0, len(joined), 100)]
        for group, ids in zip(groups, self._encode([b"".join(g).decode() for g in groups]), strict=True):
            ends, cuts = np.cumsum(self.bytes[ids]), np.cumsum([len(c) for c in group])
            at = np.searchsorted(ends, cuts)
            if at[-1] == len(ids) - 1 and (ends[at] == cuts).all():
                self._keep(group, [ids], np.diff(at, prepend=-1))
            else:  # a tokenizer whose tokens are no bytes
                alone += group
        found = self._encode([c.decode() for c in alone])
        self._keep(alone, found, np.array([len(x) for x in found], np.int64))

    def _keep(self, chunks: list[bytes], ids: list[np.ndarray], size: np.ndarray) -> None:
        at, n = len(self.known), len(chunks)
        end = self.n_ids + int(size.sum())
        self.ids = _room(self.ids, end)
        self.begin, self.size, self.came = (_room(a, at + n) for a in (self.begin, self.size, self.came))
        self.ids[self.n_ids:end] = np.concatenate([np.zeros(0, np.uint32), *ids])
        self.begin[at:at + n], self.size[at:at + n] = self.n_ids + np.cumsum(size) - size, size
        self.came[at:at + n] = 0
        self.n_ids = end
        self.known.update(zip(chunks, range(at, at + n), strict=True))

    def _forget(self) -> None:
        keep = np.flatnonzero(self.came[:len(self.known)] > 1)
        keep = keep if len(keep) < self.limit // 2 else keep[:0]
        chunks, size = list(self.known), self.size[keep]
        ids = self.ids[_spread(self.begin[keep], size)]
        self.known, self.n_ids = {}, 0
        self._keep([chunks[i] for i in keep], [ids], size)

    def numbers(self, chunks: list[bytes], words: bool) -> np.ndarray:
        """Where the ids of distinct chunks are kept."""
        if len(self.known) + len(chunks) > self.limit:
            self._forget()
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [chunks[i] for i in new]
            self._learn(fresh, words)
            at[new] = [self.known[c] for c in fresh]
        self.came[at] = np.minimum(self.came[at], 1) + 1
        return at

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        odd = pc.match_substring_regex(texts, _ODD)
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        ids, count = self._plain(pc.if_else(odd, "", texts) if len(rows) else texts)
        if not len(rows):
            return ids, count
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i in rows.tolist():
            cut = [p.encode() for p in self.pieces(texts[i].as_py())]
            chunks = list(dict.fromkeys(cut))
            number = dict(zip(chunks, self.numbers(chunks, False).tolist(), strict=True))
            of = np.array([number[c] for c in cut], np.int64)
            parts[i] = self.ids[_spread(self.begin[of], self.size[of])]
            count[i] = len(parts[i])
        return np.concatenate(parts), count

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        if offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]
        line = raw == 10
        begins = (raw == 32) | line
        begins[1:] |= line[:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        stop = _STOP[raw]
        stop[1:] &= _LETTER[raw[:-1]]
        stop[:-1] &= begins[1:]
        begins |= stop
        at = np.flatnonzero(begins).astype(np.int32)
        bounds = np.append(at, np.int32(len(raw)))
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        of = self.numbers(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), True)[chunks.indices.to_numpy()]
        size = self.size[of]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(at, offsets)]
        return self.ids[_spread(self.begin[of], size)], np.diff(upto)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every entry, as many as its size."""
    upto = np.cumsum(size)
    return np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


@lru_cache(maxsize=1)
def _cache(path: str) -> _TextIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
    return _TextIds(path)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 4000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows or bytes: the more texts, the fewer distinct chunks a text."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, frame_ids: int = BLOCK * LANES) -> DataFrame:
    """Writes the ids of all documents in ascending order of id and returns the
    written table: shard, frame, n_ids, doc_ids, doc_tokens, payload.

    Range partitions keep the order over all shards. A frame holds whole
    documents of about ``frame_ids`` ids, so a task's memory does not grow with
    its shard. Files are committed by Spark, once per task however often it is
    tried. Null texts are empty, each document ends with ``end_id``; null ids
    come first, equal ids in the order of a hash of their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), tie]  # the hash deals out the rows of one id
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard = _cache(tokenizer_path), TaskContext.get().partitionId()
        state = {"frame": 0, "ids": [], "docs": [], "counts": [], "n": 0}

        def add(ids: np.ndarray, docs: pa.Array, counts: np.ndarray) -> None:
            state["ids"].append(ids)
            state["docs"].append(docs)
            state["counts"].append(counts)
            state["n"] += len(ids)

        def close() -> pa.RecordBatch:
            ids, docs = np.concatenate(state["ids"]), pa.concat_arrays(state["docs"])
            ends = pa.array([0, len(docs)], pa.int32())
            batch = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([state["frame"]], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.ListArray.from_arrays(ends, docs),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(state["counts"]), pa.int64())),
                pa.array([encode_ids(ids)], pa.binary())],
                ["shard", "frame", "n_ids", "doc_ids", "doc_tokens", "payload"])
            state.update(frame=state["frame"] + 1, ids=[], docs=[], counts=[], n=0)
            return batch

        for batch in _gathered(batches):
            ids, counts = cache.many(batch.column(1))
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends, at = np.cumsum(counts), 0
            while at < len(counts):
                begin = ends[at] - counts[at]
                # the document that fills the frame, or all that are left
                to = min(len(counts), int(np.searchsorted(ends, begin + frame_ids - state["n"])) + 1)
                add(ids[begin:ends[to - 1]], batch.column(0).slice(at, to - at), counts[at:to])
                at = to
                if state["n"] >= frame_ids:
                    yield close()
        if state["docs"]:
            yield close()

    return written(ranged.mapInArrow(run, "shard int, frame int, n_ids long, doc_ids array<long>, "
                                          "doc_tokens array<long>, payload binary"), "token-ids")


def read_tokens(frames: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written
    frames; start counts the ids of all documents before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, count = decode_ids(row.column(4)[0].as_py()), row.column(3)[0].values.to_numpy()
                end = np.cumsum(count)
                if len(ids) != (end[-1] if len(end) else 0):
                    raise ValueError("the index and the ids of a frame differ")
                crc = [zlib.crc32(ids[b - n:b].tobytes()) for b, n in zip(end, count, strict=True)]
                k = len(count)
                yield pa.RecordBatch.from_arrays(
                    [row.column(0).take(pa.array([0] * k)), row.column(1).take(pa.array([0] * k)),
                     row.column(2)[0].values, pa.array(end - count), pa.array(count), pa.array(crc, pa.int64())],
                    ["shard", "frame", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = frames.select("shard", "frame", "doc_ids", "doc_tokens", "payload").mapInArrow(
        run, "shard int, frame int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    by_shard = frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row per written file
    before = by_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    ahead = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_ids")
    starts = (frames.select("shard", "frame", "n_ids").withColumn("ahead", ahead).join(before, "shard")
              .select("shard", "frame", (F.col("ahead") + F.col("before")).alias("base")))
    return (docs.join(starts, ["shard", "frame"])
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))

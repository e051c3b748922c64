"""Top-k by cosine distance between blocks of queries and blocks of rows.

Both sides are cut into blocks that meet by shuffle on the block's key. A task
reads one (query block, row block) pair at a time: the queries first, which it
holds as unit rows, then the rows in slices, which it only streams through. So
a task holds at most

    12 * dim * (query_block + TILE_ROWS) + 16 * k * query_block
      + 5 * TILE_QUERIES * TILE_ROWS + 16 * dim * PIECE        bytes, twice for scratch,

whatever the number of queries or rows. Each pair of blocks emits at most k
rows per query.

Every query meets every row in single precision; only rows that may be among
its k nearest, given the widest error of such a product, get a distance, in
double precision. Of equal rows of a slice only those with the smallest ids can
be among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that a task holds at once, and rows that one pair of blocks streams through it.
QUERY_BLOCK, ROW_BLOCK = 16_384, 131_072
TILE_QUERIES, TILE_ROWS = 1_024, 2_048
#: Distances taken at once in double precision.
PIECE = 65_536


def vectors_by_size(col: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: (positions, unit rows) of the vectors that have a
    direction; null, empty, zero and non-finite ones are left out."""
    sizes = np.diff(col.offsets.to_numpy())
    sizes[~np.asarray(col.is_valid())] = 0
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = col.offsets.to_numpy()[:-1]
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        m = flat[starts[at, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.linalg.norm(m, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            out[dim] = (at[ok], m[ok] / norm[ok, None])
    return out


def _ids(col: pa.Array) -> np.ndarray:
    """Ids that numpy orders as Spark does: integers as such, all else as objects."""
    if pa.types.is_integer(col.type):
        return col.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(col.to_pylist() + [None], dtype=object)[:-1]


class Tile:
    """A slice of rows: ids, and per vector length the rows that can be among
    anyone's k nearest (positions, unit rows in double and single precision)."""

    def __init__(self, ids: pa.Array, vectors: pa.ListArray, k: int):
        self.ids = _ids(ids)
        self.order, counts = np.unique(self.ids, return_inverse=True, return_counts=True)[1:]
        #: So many of the rows next to a query may be its own.
        self.spare = k + int(counts.max(initial=0))
        self.sides, self.known = {}, {}
        for dim, (pos, unit) in vectors_by_size(vectors).items():
            self.known[dim] = pos
            keep = self._foremost(pos, unit)
            self.sides[dim] = (pos[keep], unit[keep], unit[keep].astype(np.float32))

    def _foremost(self, pos: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Of equal rows, the ``spare`` ones of smallest id."""
        with np.errstate(over="ignore"):
            odd = np.arange(1, 2 * unit.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            key = (np.ascontiguousarray(unit).view(np.uint64) * (odd | np.uint64(1))).sum(1, dtype=np.uint64)
        by = np.lexsort((self.order[pos], key))
        near = np.flatnonzero(key[by][1:] == key[by][:-1])
        equal = np.zeros(len(by), bool)
        equal[near + 1] = (unit[by[near + 1]] == unit[by[near]]).all(1)
        first = np.maximum.accumulate(np.where(equal, 0, np.arange(len(by))))
        return np.sort(by[np.arange(len(by)) - first < self.spare])

    def others(self, dim: int) -> np.ndarray:
        """The ``spare`` rows of smallest id that have no distance to vectors of this length."""
        out = np.ones(len(self.ids), bool)
        if dim in self.known:
            out[self.known[dim]] = False
        at = np.flatnonzero(out)
        return at[np.argsort(self.order[at], kind="stable")[:self.spare]]


class QueryBlock:
    """Unit query vectors with the k nearest rows seen so far."""

    def __init__(self, ids: pa.Array, vectors: pa.ListArray, k: int, exclude_self: bool, parts: pa.ListArray | None = None):
        self.query_ids, self.k, self.exclude_self = ids, k, exclude_self
        self.meets = None
        if parts is not None and parts.null_count == 0:
            flat, sizes = parts.flatten().to_numpy(), parts.value_lengths().to_numpy()
            self.meets = np.zeros((len(ids), int(flat.max(initial=0)) + 1), bool)
            self.meets[np.repeat(np.arange(len(ids)), sizes), flat] = True
        self.keys = _ids(ids) if exclude_self else None
        self.sides = {dim: (at, m, m.astype(np.float32)) for dim, (at, m) in vectors_by_size(vectors).items()}
        self.best = np.full((len(ids), k), np.nan)
        self.best_id: np.ndarray | None = None

    def add(self, tile: Tile, of: int = -1) -> None:
        """Takes in a tile; with ``parts`` only by the queries that meet part ``of``."""
        if self.best_id is None:
            self.best_id = np.zeros(self.best.shape, tile.ids.dtype)
        for dim, (at, m, thin) in self.sides.items():
            others = tile.others(dim)
            if self.meets is not None:
                own = np.flatnonzero(self.meets[at, of]) if of < self.meets.shape[1] else np.zeros(0, np.int64)
                at, m, thin = at[own], m[own], thin[own]
            for lo in range(0, len(at), TILE_QUERIES):
                part = slice(lo, lo + TILE_QUERIES)
                if dim in tile.sides:
                    self._tile(at[part], m[part], thin[part], tile, *tile.sides[dim])
                if len(others):  # rows without a distance come last
                    open_ = at[part][~np.isfinite(self.best[at[part], -1])]
                    self._merge(np.repeat(open_, len(others)), np.full(len(open_) * len(others), np.inf),
                                np.tile(others, len(open_)), tile)

    def _tile(self, at: np.ndarray, m: np.ndarray, thin: np.ndarray, tile: Tile, pos: np.ndarray, unit: np.ndarray,
              unit_thin: np.ndarray) -> None:
        near = thin @ unit_thin.T
        slack = (m.shape[1] + 16) * 2.0 ** -23  # twice what a product of unit rows can be off, and more
        last = self.best[at, -1]
        floor = np.where(np.isfinite(last), 1.0 - last - slack, -np.inf)
        blank, deep = np.flatnonzero(floor == -np.inf), len(pos) - tile.spare
        if len(blank) and deep > 0:
            floor[blank] = np.partition(near[blank], deep, axis=1)[:, deep] - 2 * slack
        hit = np.flatnonzero((near >= floor.astype(np.float32)[:, None]).reshape(-1))
        for lo in range(0, len(hit), PIECE):
            row, col = np.divmod(hit[lo:lo + PIECE], len(pos))
            self._merge(at[row], 1.0 - np.einsum("ij,ij->i", m[row], unit[col]), pos[col], tile)

    def _merge(self, row: np.ndarray, dist: np.ndarray, pos: np.ndarray, tile: Tile) -> None:
        """Takes rows ``pos`` of the tile as candidates of the queries ``row``."""
        if self.exclude_self:
            other = np.asarray(self.keys[row] != tile.ids[pos], bool)
            row, dist, pos = row[other], dist[other], pos[other]
        if not len(row):
            return
        who, line = np.unique(row, return_inverse=True)
        old = ~np.isnan(self.best[who])
        line = np.concatenate([np.nonzero(old)[0], line])
        dist = np.concatenate([self.best[who][old], dist])
        ids = np.concatenate([self.best_id[who][old], tile.ids[pos]])
        by = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, dist, line))
        line, dist, ids = line[by], dist[by], ids[by]
        place = np.arange(len(line)) - np.searchsorted(line, np.arange(len(who)))[line]
        keep = place < self.k
        best, best_id = np.full((len(who), self.k), np.nan), np.zeros((len(who), self.k), ids.dtype)
        best[line[keep], place[keep]], best_id[line[keep], place[keep]] = dist[keep], ids[keep]
        self.best[who], self.best_id[who] = best, best_id

    def result(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.best_id is None:
            return
        for lo in range(0, len(self.best), TILE_QUERIES):
            rows, cols = np.nonzero(~np.isnan(self.best[lo:lo + TILE_QUERIES]))
            if len(rows):
                dist = self.best[lo + rows, cols]
                yield pa.RecordBatch.from_arrays(
                    [self.query_ids.take(pa.array(lo + rows)), pa.array(self.best_id[lo + rows, cols], id_type),
                     pa.array(dist, mask=np.isinf(dist))], ["query_id", "id", "distance"])


def _plain(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _scorer(k: int, exclude_self: bool, id_type: pa.DataType, query_block: int):
    """Reads rows sorted by (cell, qb, cb, side, part): queries (side 0), then rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, waiting = None, None, []

        def opened() -> list[QueryBlock]:
            t = pa.Table.from_batches(waiting).combine_chunks()
            return [QueryBlock(_plain(p.column("query_id")), _plain(p.column("vec")), k, exclude_self, _plain(p.column("parts")))
                    for p in (t.slice(at, query_block).combine_chunks() for at in range(0, t.num_rows, query_block))]

        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(lo, TILE_ROWS)
                keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in range(5)])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows], strict=True):
                    now, side = tuple(keys[:3, a].tolist()), keys[3, a]
                    if now != key:
                        for block in blocks or []:
                            yield from block.result(id_type)
                        key, blocks, waiting = now, None, []
                    run_rows = pa.Table.from_batches([part.slice(a, b - a)]).combine_chunks()
                    if side == 0:
                        waiting += run_rows.to_batches()
                        continue
                    if blocks is None:
                        blocks = opened() if waiting else []
                        waiting = []
                    tile = Tile(_plain(run_rows.column("id")), _plain(run_rows.column("vec")), k) if blocks else None
                    for block in blocks:
                        block.add(tile, int(keys[4, a]))
        for block in blocks or []:
            yield from block.result(id_type)

    return run


def block_count(rows: Column, block: int) -> Column:
    """Blocks of ``block`` rows for a count, at least one."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(block))).cast("int")


def dealt(df: DataFrame, keys: list, own: Column, other: Column) -> DataFrame:
    """``df`` with its block ``own_b`` out of ``own`` blocks (by hash of ``keys``),
    once for each of the ``other`` side's blocks ``other_b``."""
    return (df.withColumn("own_b", F.pmod(F.xxhash64(*keys), own.cast("long")).cast("int"))
            .withColumn("other_b", F.explode(F.sequence(F.lit(0), other - F.lit(1)))))


def block_topk(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = False,
               query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, distance, rank of the k nearest rows of each query.

    ``queries`` (cell, own_b, other_b, query_id, vec) and ``rows`` (cell, own_b,
    other_b, id, vec) come from :func:`dealt`; a pair of blocks meets within
    its cell. If rows have a ``part`` (int) and queries ``parts`` (array<int>), a
    query meets only the rows of its parts. Ties go to the smaller id, rows without a distance come last."""
    q_type, id_type = queries.schema["query_id"].dataType, rows.schema["id"].dataType
    parts = F.lit(None).cast("array<int>")
    left = queries.select("cell", F.col("own_b").alias("qb"), F.col("other_b").alias("cb"), F.lit(0).alias("side"),
                          F.lit(-1).alias("part"), "query_id", F.lit(None).cast(id_type).alias("id"), "vec",
                          F.col("parts") if "parts" in queries.columns else parts.alias("parts"))
    right = rows.select("cell", F.col("other_b").alias("qb"), F.col("own_b").alias("cb"), F.lit(1).alias("side"),
                        F.col("part") if "part" in rows.columns else F.lit(-1).alias("part"),
                        F.lit(None).cast(q_type).alias("query_id"), "id", "vec", parts.alias("parts"))
    schema = T.StructType([T.StructField("query_id", q_type), T.StructField("id", id_type),
                           T.StructField("distance", T.DoubleType())])
    met = (left.union(right).repartition("cell", "qb", "cb").sortWithinPartitions("cell", "qb", "cb", "side", "part")
           .mapInArrow(_scorer(k, exclude_self, to_arrow_type(id_type), query_block), schema))
    nearest = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc())
    return met.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)

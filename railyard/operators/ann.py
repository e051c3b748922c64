"""Approximate nearest neighbours as an IVF index.

* Build (E5): ``pyspark.ml`` ``KMeans`` on unit vectors (Euclidean on unit
  vectors orders like cosine) gives ``ncells`` centroids, about the square root
  of the row count by default; every row goes to its nearest cell and the index
  is written as parquet partitioned by cell under the shared checkpoint folder.
  Only the centroids (``ncells x dim``) reach the driver.
* ``nprobe`` is measured when the index is built and kept with it: the least
  number of cells that holds ``RECALL`` of the exact ``SAMPLE_K`` nearest rows of
  ``SAMPLE`` rows taken as queries (in the order of a hash of their ids).
* Search (E6): each query picks its ``nprobe`` nearest centroids, then queries
  and rows of a group of cells meet in blocks (:mod:`railyard.operators.block_topk`),
  each query only with the rows of its own cells. Both sides of a large group are
  cut, from counts by group that are joined on, so a task's memory grows with
  neither rows nor queries.
* Probing every cell makes the search exact (equal to E3).
* :func:`ann_topk_pruned` is exact without that: a cell's radius is the widest
  angle between its centroid and its rows, so by the triangle inequality no row
  of a cell is nearer to a query than the angle to the centroid less the radius.
  The query's nearest cells give a k-th distance, and only cells that may beat
  it are searched. How many that are is the data's doing: few where the rows
  form clusters, nearly all where they do not.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator, Optional

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from railyard.operators.block_topk import QUERY_BLOCK, ROW_BLOCK, block_count, block_topk, dealt, vectors_by_size
from railyard.operators.search import vector_topk_batch
from railyard.session import materialized, scratch_path


#: Queries of the sample by which a build chooses nprobe, neighbours of each, and the
#: share of them to be found: above the floor of 0.9 by more than the sample's error.
SAMPLE, SAMPLE_K, RECALL = 512, 10, 0.95


@dataclass
class IvfIndex:
    path: str
    centroids: np.ndarray
    id_col: str
    vec_col: str
    #: The indexed rows themselves, searched once the index is dropped.
    flat: Optional[DataFrame] = None
    dropped: bool = False
    #: Cells to probe, as measured at build time.
    nprobe: int = 1
    #: Widest angle between a cell's centroid and its rows; -1 for an empty cell.
    radii: Optional[np.ndarray] = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def ann_index_build(corpus: DataFrame, ncells: Optional[int] = None, id_col: str = "id", vec_col: str = "embedding",
                    seed: int = 7, max_iter: int = 20, path: Optional[str] = None) -> IvfIndex:
    """E5: k-means cells, rows written partitioned by ``cell``."""
    spark = corpus.sparkSession
    v = corpus.select(F.col(id_col), F.col(vec_col)).filter(F.size(vec_col) > 0)
    ncells = ncells or max(2, math.ceil(math.sqrt(v.count())))
    feats = Normalizer(inputCol="__v", outputCol="__u", p=2.0).transform(
        v.withColumn("__v", array_to_vector(F.col(vec_col))))
    model = KMeans(k=ncells, seed=seed, maxIter=max_iter, featuresCol="__u", predictionCol="cell",
                   initMode="k-means||").fit(feats)
    cents = np.asarray([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    cents /= np.maximum(np.linalg.norm(cents, axis=1, keepdims=True), 1e-300)
    out = model.transform(feats).select(id_col, vec_col, F.col("cell").cast("int"))
    path = path or scratch_path(spark, "ivf_index")
    out.write.mode("overwrite").partitionBy("cell").parquet(path)
    index = IvfIndex(path, cents, id_col, vec_col, corpus)
    index.radii = cell_radii(index, spark)
    index.nprobe = measured_nprobe(index, spark)
    return index


def cell_radii(index: IvfIndex, spark: SparkSession) -> np.ndarray:
    """The widest angle of each cell, -1 where a cell has no row."""
    bc = spark.sparkContext.broadcast(index.centroids)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.full(len(bc.value), -1.0)
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for dim, (at, unit) in vectors_by_size(batch.column("vec")).items():
                if dim == bc.value.shape[1]:
                    near = np.einsum("ij,ij->i", unit, bc.value[cells[at]])
                    np.maximum.at(out, cells[at], np.arccos(np.clip(near, -1.0, 1.0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["cell", "angle"])

    rows = index.frame(spark).select("cell", F.col(index.vec_col).alias("vec"))
    found = (rows.mapInArrow(widest, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle"))
             .collect())  # a row per cell
    out = np.full(len(index.centroids), -1.0)
    for r in found:
        out[r["cell"]] = r["angle"]
    return out


def measured_nprobe(index: IvfIndex, spark: SparkSession, sample: int = SAMPLE, k: int = SAMPLE_K,
                    recall: float = RECALL) -> int:
    """The least number of cells that holds ``recall`` of the exact ``k`` nearest
    rows of ``sample`` rows of the index, all cells if there is nothing to measure."""
    rows = index.frame(spark).select(F.col(index.id_col).alias("id"), F.col(index.vec_col).alias("vec"), "cell")
    asked = (rows.filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
             .select(F.col("id").alias("query_id"), "vec"))
    exact = vector_topk_batch(rows, asked, k, vec_col="vec", query_vec="vec", exclude_self=True).filter(
        "distance is not null")
    found = exact.join(rows.select("id", "cell"), "id").select("query_id", "id", "cell")
    order = asked.mapInArrow(_probe_fn(spark.sparkContext.broadcast(index.centroids), len(index.centroids)),
                             T.StructType([T.StructField("cell", T.IntegerType()), *asked.schema.fields]),
                             ).withColumn("nth", F.monotonically_increasing_id())
    first = F.min("nth").over(Window.partitionBy("query_id"))
    order = order.select("query_id", "cell", (F.col("nth") - first + 1).alias("nth"))
    need = (found.join(order, ["query_id", "cell"]).groupBy("query_id", "id").agg(F.min("nth").alias("nth"))
            .groupBy("nth").count().orderBy("nth").collect())  # at most a row per cell
    total, seen = sum(r["count"] for r in need), 0
    for r in need:
        seen += r["count"]
        if seen >= recall * total:
            return int(r["nth"])
    return len(index.centroids)


def ann_index_open_or_build(corpus: DataFrame, snapshot: str, ncells: Optional[int] = None, id_col: str = "id",
                            vec_col: str = "embedding", seed: int = 7) -> IvfIndex:
    """Open the index built for this corpus snapshot, or build it.

    The index lives under the shared checkpoint folder at a path derived
    from ``snapshot`` (e.g. the corpus location and modification time) and
    the build parameters; centroids and ``nprobe`` are stored next to the rows as a
    small parquet table, so a later job (or another driver) reopens the index
    without re-running k-means.
    """
    import hashlib
    import os

    from railyard.session import ensure_checkpoint_dir
    spark = corpus.sparkSession
    key = hashlib.sha1(f"{snapshot}|{ncells}|{seed}|{id_col}|{vec_col}|{SAMPLE}|{SAMPLE_K}|{RECALL}|radii".encode()).hexdigest()[:16]
    base = os.path.join(ensure_checkpoint_dir(spark), f"ivf-{key}")
    rows_path, cent_path = os.path.join(base, "rows"), os.path.join(base, "centroids")
    try:
        c = spark.read.parquet(cent_path).orderBy("cell").collect()
        cents = np.asarray([r["centroid"] for r in c], dtype=np.float64)
        if len(cents):
            return IvfIndex(rows_path, cents, id_col, vec_col, corpus, nprobe=c[0]["nprobe"],
                            radii=np.asarray([r["radius"] for r in c], dtype=np.float64))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # else it is not built yet
            raise
    idx = ann_index_build(corpus, ncells, id_col, vec_col, seed=seed, path=rows_path)
    spark.createDataFrame([(i, [float(x) for x in v], idx.nprobe, float(idx.radii[i])) for i, v in enumerate(idx.centroids)],
                          "cell int, centroid array<double>, nprobe int, radius double").write.mode("overwrite").parquet(cent_path)
    return idx


def ann_index_drop(index: IvfIndex) -> None:
    """E5 drop: later searches read the flat rows, exactly; the folder is left
    to the checkpoint folder's cleanup policy."""
    index.dropped = True


def _probe_fn(bc, nprobe: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = bc.value
        p = min(nprobe, len(cents))
        step = max(1, min(2_048, 65_536 // p))  # rows out of a slice are bounded too
        for batch in batches:
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                at, unit = vectors_by_size(part.column("vec")).get(cents.shape[1], (np.zeros(0, np.int64), None))
                if not len(at):
                    continue
                near = np.argsort(1.0 - unit @ cents.T, axis=1, kind="stable")[:, :p]
                rows = pa.array(np.repeat(at, p))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.reshape(-1).astype(np.int32)), part.column("query_id").take(rows),
                     part.column("vec").take(rows)], ["cell", "query_id", "vec"])
    return probe


def _grouped(part: pa.RecordBatch, at: np.ndarray, ok: np.ndarray, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per query and group of cells: (cell, query_id, vec, parts), where ``cell``
    is the group and ``parts`` are the query's cells in it. ``ok`` (queries x cells)
    says which cells a query searches; cells of group -1 have no rows."""
    for g in np.unique(groups[groups >= 0]):
        cells = np.flatnonzero(groups == g)
        own = ok[:, cells]
        sizes = own.sum(1)
        who = np.flatnonzero(sizes)
        if len(who):
            offsets = np.concatenate([[0], np.cumsum(sizes[who])]).astype(np.int32)
            parts = pa.ListArray.from_arrays(offsets, pa.array(cells[np.nonzero(own)[1]].astype(np.int32)))
            rows = pa.array(at[who])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(who), g, np.int32)), part.column("query_id").take(rows), part.column("vec").take(rows),
                 parts], ["cell", "query_id", "vec", "parts"])


def _nearest_fn(bc, groups: np.ndarray, nprobe: int):
    """The ``nprobe`` nearest cells of each query, by group."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = bc.value
        p = min(nprobe, len(cents))
        step = max(1, min(2_048, 4_000_000 // len(cents)))  # the matrix of a slice is bounded
        for batch in batches:
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                at, unit = vectors_by_size(part.column("vec")).get(cents.shape[1], (np.zeros(0, np.int64), None))
                if not len(at):
                    continue
                ok = np.zeros((len(at), len(cents)), bool)
                near = np.argsort(1.0 - unit @ cents.T, axis=1, kind="stable")[:, :p]
                ok[np.arange(len(at))[:, None], near] = True
                yield from _grouped(part, at, ok, groups)
    return probe


def _beating_fn(bc, bc_radii, first: int, groups: np.ndarray):
    """(group, query_id, vec, parts) of the cells beyond a query's ``first`` nearest that
    may hold a row nearer than the query's ``bound``; all of them if it is null."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, radii = bc.value, bc_radii.value
        step = max(1, min(2_048, 4_000_000 // len(cents)))
        for batch in batches:
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                at, unit = vectors_by_size(part.column("vec")).get(cents.shape[1], (np.zeros(0, np.int64), None))
                if not len(at):
                    continue
                cos = unit @ cents.T
                bound = part.column("bound").to_numpy(zero_copy_only=False)[at]
                reach = np.where(np.isnan(bound), np.inf, np.arccos(np.clip(1.0 - bound, -1.0, 1.0)) + 1e-6)
                ok = (np.arccos(np.clip(cos, -1.0, 1.0)) - radii <= reach[:, None]) & (radii >= 0)
                seen = np.argsort(1.0 - cos, axis=1, kind="stable")[:, :first]
                ok[np.arange(len(at))[:, None], seen] = False
                yield from _grouped(part, at, ok, groups)
    return probe


def _cell_groups(rows: DataFrame, ncells: int, row_block: int) -> np.ndarray:
    """The group of each cell: runs of cells of about ``row_block`` rows, -1 for an
    empty cell. A query is sent once to each group in which it has a cell, so what
    is moved grows with the groups and not with the cells it searches."""
    sizes = np.zeros(ncells, np.int64)
    for r in rows.groupBy("cell").count().collect():  # a row per cell
        sizes[r["cell"]] = r["count"]
    return np.where(sizes > 0, (np.cumsum(sizes) - sizes) // row_block, -1)


def _met(rows: DataFrame, probes: DataFrame, groups: np.ndarray, k: int, query_block: int, row_block: int) -> DataFrame:
    """Top-k between the probing queries and the rows of each group of cells."""
    spark = rows.sparkSession
    of = spark.createDataFrame([(c, int(g)) for c, g in enumerate(groups)], "part int, cell int")
    rows = rows.withColumnRenamed("cell", "part").join(F.broadcast(of), "part")  # a row per cell
    n_c = rows.groupBy("cell").agg(block_count(F.count(F.lit(1)), row_block).alias("n_c"))
    n_q = probes.groupBy("cell").agg(block_count(F.count(F.lit(1)), query_block).alias("n_q"))
    blocks = F.broadcast(n_c.join(n_q, "cell"))  # a row per group
    q_side = dealt(probes.join(blocks, "cell"), ["query_id", "vec"], F.col("n_q"), F.col("n_c"))
    c_side = dealt(rows.join(blocks, "cell"), ["id", "vec"], F.col("n_c"), F.col("n_q"))
    return block_topk(q_side, c_side, k, query_block=query_block)


def _sides(index: IvfIndex, queries: DataFrame, query_id: str, query_vec: str) -> tuple[DataFrame, DataFrame]:
    rows = index.frame(queries.sparkSession).select("cell", F.col(index.id_col).alias("id"), F.col(index.vec_col).alias("vec"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec"))
    if rows.schema["vec"].dataType != asked.schema["vec"].dataType:
        rows, asked = (d.withColumn("vec", F.col("vec").cast("array<double>")) for d in (rows, asked))
    return rows, asked


def _probe_schema(asked: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("cell", T.IntegerType()), *asked.schema.fields,
                         T.StructField("parts", T.ArrayType(T.IntegerType()))])


def ann_topk_pruned(index: IvfIndex, queries: DataFrame, k: int = 5, first: int = 2, *, query_id: str = "query_id",
                    query_vec: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK,
                    report: bool = False) -> DataFrame:
    """E6, exact: the top-k of the ``first`` nearest cells bounds the rest, and
    cells that cannot beat it are left out. Rows of other lengths than the
    index's vectors, or without a direction, are no candidates.

    With ``report``, one row per query instead: query_id and the number of
    index rows its cells hold (``n_visited``) out of ``n_rows``."""
    spark = queries.sparkSession
    if index.dropped:
        return vector_topk_batch(index.flat, queries, k, id_col=index.id_col, vec_col=index.vec_col,
                                 query_id=query_id, query_vec=query_vec)
    rows, asked = _sides(index, queries, query_id, query_vec)
    cents, radii = (spark.sparkContext.broadcast(x) for x in (index.centroids, index.radii))
    schema = _probe_schema(asked)
    groups = _cell_groups(rows, len(index.centroids), row_block)
    near = asked.mapInArrow(_nearest_fn(cents, groups, first), schema)
    hits = materialized(_met(rows, near, groups, k, query_block, row_block), "ann-first")
    bound = hits.filter(F.col("rank") == k).select(F.col("query_id").alias("__q"), F.col("distance").alias("bound"))
    bounded = asked.join(bound, asked["query_id"] == bound["__q"], "left").drop("__q")
    far = materialized(bounded.mapInArrow(_beating_fn(cents, radii, first, groups), schema), "ann-far")
    if report:
        size = rows.groupBy("cell").agg(F.count("*").alias("n"))
        total = size.agg(F.sum("n")).first()[0] or 0
        both = near.union(far).select("query_id", F.explode("parts").alias("cell"))
        return (both.join(F.broadcast(size), "cell").groupBy("query_id")  # a row per cell
                .agg(F.sum("n").alias("n_visited")).withColumn("n_rows", F.lit(total)))
    both = hits.drop("rank").union(_met(rows, far, groups, k, query_block, row_block).drop("rank"))
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc())
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ann_topk(index: IvfIndex, queries: DataFrame, k: int = 5, nprobe: Optional[int] = None, *, query_id: str = "query_id",
             query_vec: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Approximate top-k, by the index's own ``nprobe`` if none is given (exact
    when it reaches the number of cells)."""
    spark = queries.sparkSession
    if index.dropped:
        return vector_topk_batch(index.flat, queries, k, id_col=index.id_col, vec_col=index.vec_col,
                                 query_id=query_id, query_vec=query_vec)
    rows, asked = _sides(index, queries, query_id, query_vec)
    groups = _cell_groups(rows, len(index.centroids), row_block)
    probes = asked.mapInArrow(_nearest_fn(spark.sparkContext.broadcast(index.centroids), groups, nprobe or index.nprobe),
                              _probe_schema(asked))
    return _met(rows, probes, groups, k, query_block, row_block)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k ids found by the approximate search, per query."""
    hit = exact.join(approx.select("query_id", "id", F.lit(1).alias("__h")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("__h") / F.count("*")).alias("recall"))

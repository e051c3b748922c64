"""Chunk table that a stream upserts into (A4 with K5).

Folders under one path, all plain Parquet:

* ``chunks/batch=<id>`` and ``files/batch=<id>``: what a micro-batch ingested,
  and which documents it held. A replayed batch overwrites its own folders. The
  ledger ``files`` is written last; a batch without it does not count.
* ``base/upto=<id>``: all batches up to ``id`` merged, and ``commits``: a row for
  each finished merge. A merge that broke off has no row and is overwritten.

A document's chunks are those of the newest batch that holds it, so a file that
has shrunk, or has no chunk any more, leaves nothing behind. Merged batches stay
until the store's retention removes them; readers skip their partitions.
"""

from __future__ import annotations

import os
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def create_store(spark: SparkSession, path: str, chunk_schema: T.StructType, doc_col: str = "doc_id") -> None:
    """An empty store; ``chunk_schema`` holds ``doc_col``."""
    none = spark.createDataFrame([], chunk_schema)
    for folder, df in ((f"chunks/batch={-1}", none), (f"files/batch={-1}", none.select(doc_col)),
                       (f"base/upto={-1}", none), ("commits", spark.range(1).select((F.col("id") - 1).alias("upto")))):
        df.write.mode("overwrite").parquet(os.path.join(path, folder))


def apply_batch(path: str, batch_id: int, files: DataFrame, chunks: DataFrame, doc_col: str = "doc_id") -> None:
    """Upsert of a micro-batch: ``chunks`` replace all earlier chunks of the
    documents in ``files``. Applying a batch again changes nothing."""
    chunks.write.mode("overwrite").parquet(os.path.join(path, "chunks", f"batch={batch_id}"))
    files.select(doc_col).distinct().write.mode("overwrite").parquet(os.path.join(path, "files", f"batch={batch_id}"))


def _merged(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(os.path.join(path, "commits")).agg(F.max("upto")).first()[0]


def current_chunks(spark: SparkSession, path: str, doc_col: str = "doc_id") -> DataFrame:
    """The table as of now: the merged base without documents of later batches,
    and of each of those documents the chunks of its newest batch."""
    upto = _merged(spark, path)
    base = spark.read.parquet(os.path.join(path, "base")).filter(F.col("upto") == upto).drop("upto")
    newest = (spark.read.parquet(os.path.join(path, "files")).filter(F.col("batch") > upto)
              .groupBy(F.col(doc_col).alias("__doc")).agg(F.max("batch").alias("__newest")))
    later = spark.read.parquet(os.path.join(path, "chunks")).filter(F.col("batch") > upto)
    later = later.join(newest, later[doc_col].eqNullSafe(newest["__doc"]) & (later["batch"] == newest["__newest"]),
                       "left_semi").drop("batch")
    return base.join(newest, base[doc_col].eqNullSafe(newest["__doc"]), "left_anti").unionByName(later)


def compact_chunks(spark: SparkSession, path: str, doc_col: str = "doc_id") -> int:
    """Merge all batches so far into a new base; returns the last of them."""
    last = spark.read.parquet(os.path.join(path, "files")).agg(F.max("batch")).first()[0]
    last = -1 if last is None else last  # a folder of empty batches alone has no row
    if last > _merged(spark, path):
        current_chunks(spark, path, doc_col).write.mode("overwrite").parquet(os.path.join(path, "base", f"upto={last}"))
        spark.range(1).select(F.lit(last).cast("long").alias("upto")).write.mode("append").parquet(
            os.path.join(path, "commits"))
    return last


def newest_versions(batch: DataFrame, version_col: str, doc_col: str = "doc_id") -> DataFrame:
    """One row per document of a micro-batch: the latest version, of equal ones
    the row that sorts last."""
    order = F.to_json(F.struct(*[F.col(c) for c in batch.columns]))
    w = Window.partitionBy(doc_col).orderBy(F.col(version_col).desc_nulls_last(), order.desc())
    return batch.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def stream_upsert(docs: DataFrame, path: str, checkpoint: str,
                  ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], doc_col: str = "doc_id",
                  version_col: Optional[str] = None, compact_every: int = 0) -> None:
    """Drain a stream of document rows into the store at ``path``.

    ``ingest`` maps a micro-batch to (files, chunks); ``files`` names every
    document of the batch, also those without chunks. Every ``compact_every``
    batches the store is merged.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if version_col:
            batch = newest_versions(batch, version_col, doc_col)
        files, chunks = ingest(batch)
        apply_batch(path, batch_id, files, chunks, doc_col)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_chunks(batch.sparkSession, path, doc_col)

    q = (docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()

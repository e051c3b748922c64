"""Chunk-table maintenance and document scans.

The chunk table is a DataFrame ``id, metadata map<string,string>, contents,
embedding array<float>, created_at`` (any extra columns pass through).
Writes are plain parquet partitioned by a 7-day bucket; row-level updates
are expressed as anti-join + union so no table format with MERGE is needed.
"""

from __future__ import annotations

from functools import reduce
from typing import Optional, Sequence

from railyard.operators.metadata import metadata_text
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ACCEPTED_SUFFIXES = (".pdf", ".docx")


def file_suffix(path) -> Column:
    """Lower-cased suffix of the last path segment, '' when there is none."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(p, r"(\.[^./\\]+)$", 1))


def file_name(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/\\]*)$", 1)


def classify_files(files: DataFrame, path_col: str = "path",
                   allow: Sequence[str] = ACCEPTED_SUFFIXES,
                   original_name_col: Optional[str] = None) -> DataFrame:
    """A2: accepted/rejected split without raising per file.

    Adds ``filename`` (original name if given, else the path's name),
    ``file_type`` (lower-cased suffix), ``accepted`` and ``error``.
    """
    suf = file_suffix(path_col)
    name = file_name(path_col)
    if original_name_col:
        name = F.coalesce(F.nullif(F.col(original_name_col), F.lit("")), name)
    ok = suf.isin(*[a.lower() for a in allow])
    err = F.when(~ok, F.concat(F.lit("suffix '"), suf, F.lit("' is not one of " + ", ".join(allow))))
    return (files.withColumn("filename", name).withColumn("file_type", suf)
            .withColumn("accepted", ok).withColumn("error", err))


def scan_documents(spark: SparkSession, path: str, allow: Sequence[str] = ACCEPTED_SUFFIXES,
                   recursive: bool = True) -> DataFrame:
    """A2 source: list files under ``path`` (binaryFile) and classify them.
    Content bytes stay in the frame; parsing happens downstream."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(path))
    return classify_files(df, "path", allow)


def upsert_chunks(base: DataFrame, updates: DataFrame, key: str, version_col: str) -> DataFrame:
    """A4: insert or replace by key. Within ``updates`` the latest version per
    key wins (``version_col`` descending, nulls last; of equal versions the row
    that sorts last, so reruns agree); base rows with an updated key go."""
    order = F.to_json(F.struct(*[F.col(c) for c in updates.columns]))
    w = Window.partitionBy(key).orderBy(F.col(version_col).desc_nulls_last(), order.desc())
    updates = updates.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    kept = base.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def replace_documents(base: DataFrame, updates: DataFrame, documents: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A4 by document: all base rows of ``documents`` go, ``updates`` come."""
    gone = documents.select(F.col(doc_col).alias("__gone")).distinct()
    kept = base.join(gone, base[doc_col].eqNullSafe(gone["__gone"]), "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def delete_chunks(base: DataFrame, ids: Optional[DataFrame] = None,
                  metadata_filter: Optional[dict] = None, delete_all: bool = False,
                  key: str = "id", metadata_col: Optional[str] = "metadata") -> DataFrame:
    """A5: exactly one criterion, else ValueError.  ``ids`` is a frame of keys
    (anti-join, so any number of ids); ``metadata_filter`` is an equality
    dict on the metadata map (or on top-level columns when
    ``metadata_col`` is None)."""
    given = sum(bool(x) for x in (ids is not None, bool(metadata_filter), delete_all))
    if given != 1:
        raise ValueError("deletion takes one criterion: ids, a metadata filter or everything")
    if delete_all:
        return base.limit(0)
    if ids is not None:
        return base.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")
    match = reduce(lambda a, b: a & b, [
        F.element_at(metadata_col, F.lit(k)).eqNullSafe(F.lit(None if v is None else metadata_text(v)))
        if metadata_col else F.col(k).eqNullSafe(F.lit(v)) for k, v in metadata_filter.items()])
    return base.filter(~F.coalesce(match, F.lit(False)))


def week_bucket(ts) -> Column:
    """Start of the 7-day bucket (epoch aligned, like ``window(ts, '7 days')``)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(c.cast("timestamp"))
    week = 7 * 86400 * 1000000
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(week))).cast("timestamp_ntz")


def write_partitioned_chunk_table(df: DataFrame, path: str, ts_col: str = "created_at",
                                  mode: str = "overwrite", files_per_bucket: int = 8) -> None:
    """Parquet partitioned by the 7-day bucket of ``ts_col``. Rows are dealt
    out by bucket and a hash of the row, so a bucket is written by at most
    ``files_per_bucket`` tasks, and a large one by more than one."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_bucket))
    bucket = F.date_format(week_bucket(ts_col), "yyyy-MM-dd")
    (df.withColumn("week_bucket", bucket).repartition("week_bucket", salt)
     .write.mode(mode).partitionBy("week_bucket").parquet(path))


def bucket_range_filter(start: str, end: str, ts_col: str = "created_at") -> Column:
    """B4 on a partitioned table: the user range on ``ts`` plus the implied
    range on ``week_bucket`` so the scan prunes partitions."""
    lo = F.date_format(week_bucket(F.lit(start).cast("timestamp_ntz")), "yyyy-MM-dd")
    return ((F.col("week_bucket") >= lo) & (F.col("week_bucket") <= F.lit(end[:10]))
            & (F.col(ts_col) >= F.lit(start).cast("timestamp_ntz"))
            & (F.col(ts_col) < F.lit(end).cast("timestamp_ntz")))


def ingest_ledger(files: DataFrame, chunks: DataFrame, doc_key: str = "doc_id", filename: str = "filename",
                  job_id: Optional[Column] = None) -> DataFrame:
    """One row per file: SUCCESS with chunk count, or FAILURE with the
    error text; a rejected file never fails the job. Files are told apart by
    ``doc_key`` (a document id or path), not by name."""
    counts = chunks.groupBy(doc_key).agg(F.count("*").alias("chunks_ingested"))
    j = files.join(counts, doc_key, "left")
    jid = job_id if job_id is not None else F.sha2(F.col(doc_key).cast("string"), 256).substr(1, 16)
    status = F.when(F.col("accepted") & F.col("error").isNull(), F.lit("SUCCESS")).otherwise(F.lit("FAILURE"))
    return j.select(jid.alias("job_id"), F.col(filename).alias("filename"), status.alias("status"),
                    F.when(status == "SUCCESS", F.coalesce(F.col("chunks_ingested"), F.lit(0)))
                    .cast("long").alias("chunks_ingested"),
                    F.when(status == "FAILURE", F.col("error")).alias("error"))


def list_documents(chunks: DataFrame, filename="filename", file_type="file_type") -> DataFrame:
    """Chunk count per (filename, file_type), ordered by filename with
    nulls last (the source store's default)."""
    fn = F.col(filename) if isinstance(filename, str) else filename
    ft = F.col(file_type) if isinstance(file_type, str) else file_type
    return (chunks.groupBy(fn.alias("filename"), ft.alias("file_type"))
            .agg(F.count("*").alias("chunk_count"))
            .orderBy(F.col("filename").asc_nulls_last(), F.col("file_type").asc_nulls_last()))

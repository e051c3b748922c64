"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, unused, written


def normal_text(text_col: str = "text"):
    """The text as it is compared: null is empty, each run of white space one space."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def digest_runs(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """(doc_id, digest, proof, run): the run is chosen by the id, so copies of a
    hot text are spread over all runs and rows with one id share a run."""
    text = docs.select(F.col(id_col).alias("doc_id"), normal_text(text_col).alias("norm"))
    return text.select(
        "doc_id", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("digest"),
        F.struct(F.length("norm").alias("chars"), F.xxhash64("norm").alias("check")).alias("proof"),
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"))


def merge_runs(rows: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """(run, digest, keep_id, n) for every run and digest of ``rows``.

    Upwards, ``fan_in`` neighbouring runs meet per round until one is left;
    every round keeps one verified row per digest. Downwards, each level hands
    the result to the at most ``fan_in`` rows it came from, so no digest ever
    joins more than ``fan_in`` rows, however many copies a text has.
    """
    first = rows.groupBy("run", "digest").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"),
        F.min("proof").alias("low"), F.max("proof").alias("high"))
    levels = [written(first, "run")]
    while runs > 1:
        runs = -(-runs // fan_in)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        # the bounds of a second hash and of the length must agree for equal texts
        levels.append(written(up.groupBy("run", "digest").agg(
            F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"),
            F.min("low").alias("low"), F.max("high").alias("high")), "run"))
    top = levels.pop()
    found = top.select("run", "digest", "keep_id", F.when(
        F.col("low") == F.col("high"), F.col("n")).otherwise(F.raise_error(
            F.lit("equal digests of different texts")).cast("long")).alias("n"))
    for level in reversed(levels):
        below = level.select(F.col("run").alias("own"), "digest",
                             F.floor(F.col("run") / fan_in).cast("int").alias("run"))
        found = below.join(found, ["run", "digest"]).select(
            F.col("own").alias("run"), "digest", "keep_id", "n")
    return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the smallest id stays; null ids come last, a group
    of null ids keeps one row and has a null keep_id. Null and empty texts are
    equal. Of repeated rows with the smallest id one is kept. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = written(digest_runs(docs, id_col, text_col, runs), "digests")
    found = merge_runs(rows, runs, fan_in)
    nth = F.row_number().over(Window.partitionBy("run", "digest").orderBy(F.col("doc_id").asc_nulls_last()))
    return (rows.select("doc_id", "digest", "run").withColumn("nth", nth)
            .join(found, ["run", "digest"])
            .select("doc_id", "keep_id", F.col("n").alias("group_size"),
                    ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                runs: int = 64, fan_in: int = 4) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns kept."""
    own, keep_id, keep_digest = unused(docs, "_digest", "_keep_id", "_keep_digest")
    kept = (exact_dedup(docs, id_col, text_col, runs, fan_in).filter("kept")
            .select(F.col("doc_id").alias(keep_id), F.unhex("text_sha256").alias(keep_digest)))
    rows = docs.withColumn(own, F.unhex(F.sha2(F.encode(normal_text(text_col), "UTF-8"), 256)))
    mine = rows.join(kept, rows[id_col].eqNullSafe(kept[keep_id]) & (rows[own] == kept[keep_digest]), "left_semi")
    return mine.dropDuplicates([id_col, own]).drop(own)

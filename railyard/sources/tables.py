"""Readers for the input tables and the FAQ seed file (A1)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Tables whose rows carry long text and feed CPU-heavy per-row regex work.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``; scans prune columns and push
    filters.  Text tables are spread over the cores when the scan yields
    fewer partitions than the default parallelism (one large row group);
    on a cluster-sized table the scan already has more splits than cores
    and no shuffle is added."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name in TEXT_TABLES:
        df = spread(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when the frame has fewer partitions than
    the cluster's default parallelism."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


FAQ_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("category", T.StringType()),
])


def read_faq_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: ``;``-separated FAQ seed with a header: question, answer, category."""
    return (spark.read.option("sep", ";").option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').schema(FAQ_SCHEMA).csv(path))


def write_faq_csv(df: DataFrame, path: str) -> None:
    """Write ``question, answer, category`` in the same ``;`` format."""
    (df.select("question", "answer", "category").write.mode("overwrite").option("sep", ";")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))

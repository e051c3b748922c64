"""Shared helpers of the llm operators: written tables, components, chunk caches."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.session import scratch_path, ship_package

#: The white space that splits words and is collapsed before exact comparison.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ships the package and keeps Arrow batches small, as rows hold whole texts;
    a batch size that the session sets itself stays."""
    ship_package(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: the lineage
    ends there, so a lost executor costs a re-read and no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``docs`` has it (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns of both frames."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): root is the smallest id that
    can be reached.

    Each round takes the smallest label among the neighbours and then follows
    labels once more (pointer jumping), so the rounds grow with the logarithm
    of a path's length. Labels stay distributed; only a count of changed labels
    reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a"))
                   .filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
                     .select("id", F.least("id", "near").alias("root")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("id", "b"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near")))
        step = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("next"))
        hop = labels.select(F.col("id").alias("next"), F.col("root").alias("far"))
        step = written(step.join(hop, "next", "left")
                       .select("id", F.col("root").alias("old"),
                               F.least("next", F.coalesce("far", "next")).alias("root")), "labels")
        changed = step.filter("old <> root").limit(1).count()
        labels = step.select("id", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class ChunkCache:
    """Bytes of the ids of a text, looked up by chunks between single spaces.

    A single space or newline between two characters that are no white space is
    always a token boundary of byte-level BPE patterns: a space joins the word
    after it, a newline stands alone. So a text may be encoded chunk by chunk,
    and each distinct chunk once. Texts with other white space are cut only at
    spaces between plain characters. ``encode(list of str) -> list of bytes``
    gets the chunks not seen yet; the cache is emptied at ``limit`` entries.
    """

    _SAFE = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 300_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            words = line.split()
            if not words or " ".join(words) != line:
                words = self._SAFE.split(text)
                return [words[0], *[" " + w for w in words[1:]]] if text else []
            if i:
                out.append("\n")
            out.append(words[0])
            out += [" " + w for w in words[1:]]
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        cut = [self.pieces(t) for t in texts]
        known = self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        return [b"".join(map(known.__getitem__, ps)) for ps in cut]

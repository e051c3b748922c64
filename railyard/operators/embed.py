"""Embedding and the embedding cache.

* The built-in encoder is hashed term frequency (``Tokenizer`` ->
  ``HashingTF`` -> ``Normalizer``): JVM-only, deterministic, no network.
  A user encoder (a function from a pandas Series of texts to vectors) runs
  in ``mapInPandas`` on distinct texts, one call per Arrow batch.
* The cache is a table ``(model, text_sha, embedding, set_at)``.  Lookups
  are a join on the key; expiry keeps the last set time per key, because a
  read does not extend an entry's life.
"""

from __future__ import annotations

from typing import Callable, Optional

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from railyard.functions.scan import previous, running
from railyard.functions.text import normalize_for_embedding
from railyard.session import materialized

Encoder = Callable[[pd.Series], list]


def hashed_tf_embed(df: DataFrame, text_col: str, out: str = "embedding", dim: int = 64) -> DataFrame:
    """Default encoder: lower-cased whitespace tokens hashed into ``dim``
    buckets, L2-normalised, as ``array<float>`` (all rows, narrow)."""
    tmp = df.withColumn("__txt", F.coalesce(F.col(text_col), F.lit("")))
    toks = Tokenizer(inputCol="__txt", outputCol="__tok").transform(tmp)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim).transform(toks)
    nv = Normalizer(inputCol="__tf", outputCol="__nv", p=2.0).transform(tf)
    return (nv.withColumn(out, vector_to_array("__nv", "float32"))
            .drop("__txt", "__tok", "__tf", "__nv"))


def embed_batch(df: DataFrame, text_col: str, encoder: Optional[Encoder] = None, dim: int = 64,
                out: str = "embedding") -> DataFrame:
    """Embed all texts of a frame, order and rows kept.

    Texts are normalised (newline -> blank) first.  With a user encoder the
    distinct texts are encoded once each (batched per Arrow batch) and joined
    back by their sha-256; the built-in encoder is cheap enough to run per row.
    """
    norm = df.withColumn("__norm", normalize_for_embedding(text_col))
    if encoder is None:
        return hashed_tf_embed(norm, "__norm", out, dim).drop("__norm")
    norm = norm.withColumn("__sha", F.sha2(F.coalesce(F.col("__norm"), F.lit("")), 256))
    distinct = norm.select("__sha", "__norm").dropDuplicates(["__sha"])

    def run(batches):
        for pdf in batches:
            vecs = encoder(pdf["__norm"].fillna(""))
            yield pd.DataFrame({"__sha": pdf["__sha"].to_numpy(),
                                out: [np.asarray(v, dtype=np.float32) for v in vecs]})

    schema = T.StructType([T.StructField("__sha", T.StringType()),
                           T.StructField(out, T.ArrayType(T.FloatType()))])
    emb = distinct.mapInPandas(run, schema)
    return norm.join(emb, "__sha", "left").drop("__sha", "__norm")


def cache_key(model, text) -> Column:
    m = F.col(model) if isinstance(model, str) else model
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(m, F.lit(":"), F.sha2(F.coalesce(t, F.lit("")), 256))


def embedding_cache_lookup(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text",
                           encoder: Optional[Encoder] = None, dim: int = 64,
                           now: Optional[Column] = None) -> tuple[DataFrame, DataFrame]:
    """Hits come from the cache by (model, sha256(text)); misses are
    embedded and returned as new cache entries.

    Returns ``(result, new_entries)``; ``result`` keeps every input row and
    adds ``text_sha``, ``embedding`` and ``cache_hit``. Each distinct missing
    text is embedded once; its vectors are materialised, the texts are not.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    held = (cache.filter((F.col("model") == F.lit(model)) & F.col("embedding").isNotNull())
            .select("text_sha", "embedding").dropDuplicates(["text_sha"]))
    missing = (texts.select(sha.alias("text_sha"), F.col(text_col).alias("__text")).dropDuplicates(["text_sha"])
               .join(held.select("text_sha"), "text_sha", "left_anti"))
    made = materialized(embed_batch(missing, "__text", encoder, dim).select("text_sha", "embedding"), "embedded")
    known = held.withColumn("cache_hit", F.lit(True)).union(made.withColumn("cache_hit", F.lit(False)))
    result = texts.withColumn("text_sha", sha).join(known, "text_sha")
    new_entries = made.select(F.lit(model).alias("model"), "text_sha", "embedding").withColumn(
        "set_at", now if now is not None else F.current_timestamp())
    return result, new_entries


def embedding_cache_expire(cache_log: DataFrame, now: str, ttl_seconds: int = 86400,
                           key_cols=("model", "text_sha"), ts_col: str = "set_at") -> DataFrame:
    """D3: live entries at ``now``: the last set per key plus TTL is still
    ahead.  Gets never refresh, so only sets are in the log."""
    last = cache_log.groupBy(*key_cols).agg(F.max(ts_col).alias("last_set"))
    alive = (F.col("last_set") + F.make_interval(secs=F.lit(ttl_seconds))) > F.lit(now).cast("timestamp_ntz")
    return last.filter(alive)


def embedding_cache_evict(cache: DataFrame, keys: DataFrame, key_cols=("model", "text_sha")) -> DataFrame:
    """Remove entries by key (anti-join)."""
    return cache.join(keys.select(*key_cols).distinct(), list(key_cols), "left_anti")


def decode_payload(df: DataFrame, payload_col: str, schema: str = "array<double>") -> DataFrame:
    """Undecodable payloads parse to null (PERMISSIVE) and count as a
    miss; ``corrupt`` marks them for the report."""
    parsed = F.from_json(F.col(payload_col), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("decoded", parsed).withColumn(
        "corrupt", F.col(payload_col).isNotNull() & F.col("decoded").isNull())


def embedding_cache_replay(requests: DataFrame, key_col: str, ts_col: str, id_col: str,
                           ttl_seconds: int = 86400) -> DataFrame:
    """Mark each request hit or miss.  A miss sets the entry (expiry =
    request time + TTL); a hit does not extend it.

    Per key, a gap of at least the TTL since the previous request always
    starts fresh, so keys are cut into segments there (two-level scans, so
    a hot key is spread over tasks) and each segment is folded in order with
    ``aggregate``.  The fold carries
    only (expiry, request ids of misses) and the per-segment array holds two
    longs per request.
    """
    ttl = ttl_seconds * 1_000_000
    r = requests.select(F.col(key_col).alias("key"), F.col(id_col).alias("rid"),
                        F.unix_micros(F.col(ts_col).cast("timestamp")).alias("t"))
    # segment boundaries with two-level scans (hour buckets), so a hot key
    # is not one window task
    order, bucket = [F.col("t"), F.col("rid")], F.floor(F.col("t") / F.lit(3_600_000_000)).cast("long")
    r = previous(r, ["key"], order, bucket, "t", "__prev")
    r = r.withColumn("__brk", F.when(F.col("t") - F.col("__prev") >= ttl, 1).otherwise(0))
    r = running(r, ["key"], order, bucket, {"__seg": ("sum", F.col("__brk"))})
    g = r.groupBy("key", "__seg").agg(F.array_sort(F.collect_list(F.struct("t", "rid"))).alias("reqs"))
    init = F.struct(F.lit(-(2 ** 62)).cast("long").alias("exp"), F.array().cast("array<long>").alias("miss"))
    fold = F.aggregate("reqs", init, lambda acc, x: F.when(
        x["t"] >= acc["exp"],
        F.struct((x["t"] + F.lit(ttl)).alias("exp"), F.concat(acc["miss"], F.array(x["rid"])).alias("miss"))
    ).otherwise(acc))
    g = g.withColumn("__miss", fold["miss"])
    e = g.select("key", "__miss", F.explode("reqs").alias("r"))
    return e.select(F.col("key").alias(key_col), F.col("r.rid").alias(id_col),
                    F.timestamp_micros(F.col("r.t")).cast("timestamp_ntz").alias(ts_col),
                    (~F.array_contains("__miss", F.col("r.rid"))).alias("cache_hit"))

"""Retrieval composition (H8): search -> payload -> guards -> context text."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, functions as F

from railyard.functions.text import Counter, is_blank, token_count
from railyard.operators.retrieval_guards import apply_retrieval_guards, format_context
from railyard.operators.search import hit_payload, vector_topk_batch
from railyard.policy import DEFAULT_POLICY, Policy
from railyard.session import ensure_checkpoint_dir


def search_candidates(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
                      query_vec: str = "embedding", id_col: str = "id", vec_col: str = "embedding",
                      content: str = "content", filename: str = "filename", file_type: str = "file_type",
                      exclude_self: bool = False, payload: Optional[DataFrame] = None,
                      payload_id: Optional[str] = None, hits: Optional[DataFrame] = None,
                      counter: Counter = None, text: bool = True) -> DataFrame:
    """Top-k hits with the payload the guards need; tokens are counted and text
    is attached only for the hits.  ``payload`` (with key ``payload_id``)
    supplies the text when vectors and text live in different tables; otherwise
    the corpus carries both.  ``counter`` counts the tokens of a text.  Without
    ``text`` the column ``content`` only tells blank ("") from other texts ("x")."""
    if hits is None:
        q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("__qv"))
        hits = vector_topk_batch(corpus, q, k, id_col=id_col, vec_col=vec_col, query_id="query_id",
                                 query_vec="__qv", exclude_self=exclude_self, materialize=True)
    hits = hits.filter(F.col("rank") <= k)
    body = F.col(content) if text else F.when(is_blank(content), F.lit("")).otherwise(F.lit("x"))
    cols = [body.alias("content"), F.col(filename).alias("filename"),
            F.col(file_type).alias("file_type"), token_count(content, counter).alias("token_count")]
    if payload is None:
        c = hit_payload(hits, corpus, id_col, cols)
    else:
        c = hit_payload(hits, payload, payload_id or id_col, cols)
    return c.withColumnRenamed("id", "chunk_id").withColumn(
        "token_count", F.coalesce(F.col("token_count"), F.lit(1).cast("long")))


def retrieve_knowledge(queries: DataFrame, corpus: DataFrame, policy: Policy = DEFAULT_POLICY, *,
                       overfetch: Optional[int] = None, materialize: bool = False, text: bool = True,
                       **kw) -> DataFrame:
    """H8: search with ``limit = max(top_k, 1)`` (the limit is applied before
    the guards, so guards may leave fewer than k even when more matching
    chunks exist; ``overfetch`` raises the search limit), then H6 and H7.

    The result (one row per query, at most k chunks) is what the model
    would read; with ``materialize`` it is checkpointed once, for callers that reuse it
    (citation checks, routing, reports) reads it instead of re-planning it.
    Without ``text`` chunks have no content and there is no context: the guards'
    decisions alone, for callers that move ids.
    """
    k = overfetch if overfetch is not None else max(policy.top_k, 1)
    cands = search_candidates(queries, corpus, k, text=text, **kw)
    qid = kw.get("query_id", "query_id")
    guarded = apply_retrieval_guards(cands, queries.select(F.col(qid).alias("query_id")), policy)
    if text:
        guarded = format_context(guarded)
    else:
        guarded = guarded.withColumn("chunks", F.transform("chunks", lambda c: c.dropFields("content")))
    if materialize:
        ensure_checkpoint_dir(guarded.sparkSession)
        guarded = guarded.checkpoint(eager=True)
    return guarded

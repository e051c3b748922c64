"""Ingest composition (A8): blocks -> headings -> packed chunks ->
contextualised text -> token counts -> index -> embedding -> upsert.

Embeds the contextualised text but stores the raw chunk text, as the
reference pipeline does.  The chunk id is derived from (doc_id,
chunk_index) with sha-256, so files of one name in two folders stay apart, and
re-ingesting a file replaces all of its chunks, also where it has fewer now
(the reference draws a new time-based id per chunk on every ingest).
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, functions as F

from railyard.operators import chunking as C
from railyard.operators.embed import Encoder, embed_batch
from railyard.policy import DEFAULT_POLICY, Policy
from railyard.sources.chunk_table import replace_documents


def chunk_documents(blocks: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    headed = C.attach_headings(blocks)
    chunks = C.pack_chunks(headed, policy.chunk_pack_limit)
    chunks = C.contextualize(chunks, policy.chunk_max_tokens)
    return C.chunk_index(chunks)


def ingest_documents(blocks: DataFrame, files: DataFrame, policy: Policy = DEFAULT_POLICY,
                     base: Optional[DataFrame] = None, encoder: Optional[Encoder] = None,
                     dim: int = 64, created_at=None) -> DataFrame:
    """A8.  ``files``: ``doc_id, filename, file_type, file_path, accepted``
    (output of ``classify_files``); only accepted files are chunked. Chunks of
    them in ``base`` go, all other rows of ``base`` stay."""
    ok = files.filter(F.col("accepted")).select("doc_id", "filename", "file_type", "file_path")
    # counted ahead of the join: the pass that places the blocks moves no text
    chunks = chunk_documents(C.sized(blocks, policy.chunk_pack_limit).join(ok.select("doc_id"), "doc_id", "left_semi"), policy)
    chunks = chunks.join(ok, "doc_id")
    emb = embed_batch(chunks, "content", encoder, dim)
    meta = F.create_map(
        F.lit("filename"), F.col("filename"), F.lit("file_type"), F.col("file_type"),
        F.lit("file_path"), F.col("file_path"), F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("raw_token_count"), F.col("raw_tokens").cast("string"),
        F.lit("contextualized_token_count"), F.col("contextualized_tokens").cast("string"))
    out = emb.select(
        F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("id"),
        meta.alias("metadata"), F.col("raw_text").alias("contents"), "embedding",
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
        "doc_id", "filename", "file_type", "chunk_index",
        F.col("raw_tokens").alias("raw_token_count"),
        F.col("contextualized_tokens").alias("contextualized_token_count"), "fell_back")
    return out if base is None else replace_documents(base, out, ok, "doc_id")

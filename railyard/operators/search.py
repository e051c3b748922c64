"""Vector search: cosine distance, single and batch exact top-k, filters.

Batch search cuts queries and corpus into blocks, lets every pair of blocks
meet by shuffle, and keeps k rows per query and pair (``operators.block_topk``,
which states the memory of a task). No (query, row) pair becomes a Spark row,
neither side passes the driver, and nothing is broadcast. The final ranking is
``row_number() <= k`` over ``query_id``, planned with a partial
``WindowGroupLimit`` before the shuffle. The arithmetic is that of every query
against every row; for very large query sets use :mod:`railyard.operators.ann`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from railyard.functions.vectors import cosine_distance, cosine_distance_to
from railyard.operators.block_topk import QUERY_BLOCK, ROW_BLOCK, block_count, block_topk, dealt
from railyard.session import ensure_checkpoint_dir


def pairwise_distance(df: DataFrame, a: str, b: str, out: str = "distance") -> DataFrame:
    """``1 - cos(a, b)`` for two vector columns of one row."""
    return df.withColumn(out, cosine_distance(a, b))


def vector_topk(corpus: DataFrame, q: list[float], k: int = 5, id_col: str = "id",
                vec_col: str = "embedding") -> DataFrame:
    """Nearest ``k`` rows to one literal query vector.

    ``orderBy(...).limit(k)`` becomes ``TakeOrderedAndProject``: every task
    keeps its own k best rows, only those reach the final merge.
    """
    return (corpus.withColumn("distance", cosine_distance_to(vec_col, q))
            .orderBy(F.col("distance").asc_nulls_last(), F.col(id_col).asc())
            .limit(k))


def vector_topk_batch(corpus: DataFrame, queries: DataFrame, k: int = 5, *,
                      id_col: str = "id", vec_col: str = "embedding",
                      query_id: str = "query_id", query_vec: str = "embedding",
                      exclude_self: bool = False, materialize: bool = False,
                      query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Exact top-k for many queries.

    Returns ``query_id, id, distance, rank`` (rank is 1-based, ties on id).
    Queries whose vector is null or all zero get no rows; a vector of another
    length than the query's, null or zero has a null distance and comes last;
    with ``exclude_self`` the row of the query's own id is no candidate. Rows
    without an id are no candidates.

    The number of blocks comes from the counts of both sides as scalar
    subqueries, so nothing runs before the result is asked for. Callers that
    read the result several times pass ``materialize``: it is then checkpointed
    once to the shared folder.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = corpus.select(F.lit(0).alias("cell"), F.col(id_col).alias("id"),
                         F.col(vec_col).alias("vec")).filter("id is not null")
    asked = queries.select(F.lit(0).alias("cell"), F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec"))
    if rows.schema["vec"].dataType != asked.schema["vec"].dataType:
        rows, asked = (d.withColumn("vec", F.col("vec").cast("array<double>")) for d in (rows, asked))
    n_q = block_count(asked.select(F.count(F.lit(1))).scalar(), query_block)
    n_c = block_count(rows.select(F.count(F.lit(1))).scalar(), row_block)
    out = block_topk(dealt(asked, ["query_id", "vec"], n_q, n_c), dealt(rows, ["id", "vec"], n_c, n_q),
                     k, exclude_self, query_block)
    if materialize:
        ensure_checkpoint_dir(corpus.sparkSession)
        out = out.checkpoint(eager=True)
    return out


def join_payload(hits: DataFrame, corpus: DataFrame, id_col: str, cols: list, how: str = "left") -> DataFrame:
    """Attach corpus columns to top-k hits by one join on the id; ``how='left'``
    keeps hits whose id has no corpus row (payload null)."""
    return hits.join(corpus.select(F.col(id_col).alias("id"), *cols), "id", how)


def hit_payload(hits: DataFrame, corpus: DataFrame, id_col: str, cols: list) -> DataFrame:
    """Like :func:`join_payload`, for long texts: the corpus is first cut to the
    rows that were hit, so that only those are moved (Spark may broadcast the
    ids by size), and then joined to the hits. ``hits`` should be materialised,
    as it is read twice."""
    ids = hits.select("id").distinct()
    return join_payload(hits, corpus.join(ids, corpus[id_col] == ids["id"], "left_semi"), id_col, cols)


def vector_topk_filtered(corpus: DataFrame, queries: DataFrame, k: int = 5, *,
                         corpus_filter=None, **kw) -> DataFrame:
    """Filters apply before the limit (exact for a flat scan)."""
    if corpus_filter is not None:
        corpus = corpus.filter(corpus_filter)
    return vector_topk_batch(corpus, queries, k, **kw)


def search_result_frame(hits: DataFrame, corpus: DataFrame, id_col: str,
                        content_col: str, metadata: dict[str, str]) -> DataFrame:
    """``id (string), content, distance`` plus metadata as flat columns."""
    cols = [F.col(content_col).alias("content")] + [F.col(v).alias(k) for k, v in metadata.items()]
    out = join_payload(hits, corpus, id_col, cols, how="inner")
    return out.select(F.col("query_id"), F.col("id").cast("string").alias("id"), "content",
                      "distance", "rank", *metadata.keys())

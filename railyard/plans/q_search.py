"""Registered search and gate queries (E1-E4, E7, G1-G4) over ``embeddings``
(corpus and queries, self-match excluded) and ``documents`` (content,
``source`` as filename, ``lang`` as file type; ``doc_id = vec_id``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions.vectors import cosine_distance
from railyard.operators import gate as G
from railyard.operators import search as S
from railyard.plans.registry import register
from railyard.policy import DEFAULT_POLICY
from railyard.sources.tables import table

GATE_T = 0.62
SWEEP = [0.45, 0.55, 0.6, 0.62, 0.65, 0.7]

# DuckDB: all (query, row) distances, self excluded.
SQL_PAIRS = """
  SELECT q.vec_id AS query_id, q.label AS q_label, c.vec_id AS id,
         list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id"""


def sql_topk(k: int) -> str:
    return f"""
  SELECT query_id, id, distance, rank FROM (
    SELECT query_id, id, distance,
           row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
    FROM ({SQL_PAIRS}) p
  ) WHERE rank <= {k}"""


def emb_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), "embedding")


def topk_all(spark, sf, k=5, corpus=None):
    e = table(spark, sf, "embeddings")
    return S.vector_topk_batch(corpus if corpus is not None else e, emb_queries(spark, sf), k,
                               id_col="vec_id", exclude_self=True)


@register("cosine_distance", sql="""
SELECT a.vec_id AS vec_id, b.vec_id AS next_id,
       round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine_distance(spark, sf):
    """Distance between each vector and the next id (equi-join, whole table)."""
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                 F.col("embedding").alias("b"))
    return S.pairwise_distance(a.join(b, "vec_id"), "a", "b").select("vec_id", "next_id", "distance")


@register("vector_topk", sql="""
WITH q AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT c.vec_id AS id, c.label AS label,
       round(list_cosine_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance
FROM embeddings c, q WHERE c.vec_id <> q.vec_id
ORDER BY list_cosine_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), c.vec_id LIMIT 5""")
def q_vector_topk(spark, sf):
    """Top-5 for one literal query vector (the lowest id's vector)."""
    e = table(spark, sf, "embeddings")
    first = e.orderBy("vec_id").select("vec_id", "embedding").first()
    corpus = e.filter(F.col("vec_id") != F.lit(first["vec_id"]))
    return S.vector_topk(corpus, list(first["embedding"]), 5, id_col="vec_id").select(
        F.col("vec_id").alias("id"), "label", "distance")


@register("vector_topk_batch", sql=f"""
SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({sql_topk(5)})""")
def q_vector_topk_batch(spark, sf):
    """Top-5 neighbours of every vector."""
    return topk_all(spark, sf, 5)


@register("vector_topk_filtered", sql="""
SELECT query_id, id, round(distance, 6) AS distance, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY
             list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
  WHERE c.label IN (1, 3, 5) OR (c.label >= 8 AND c.vec_id % 2 = 0)
) WHERE rank <= 5""")
def q_vector_topk_filtered(spark, sf):
    """Metadata filter + predicate tree on the corpus, applied before the limit."""
    e = table(spark, sf, "embeddings")
    flt = F.col("label").isin(1, 3, 5) | ((F.col("label") >= 8) & (F.col("vec_id") % 2 == 0))
    return S.vector_topk_filtered(e, emb_queries(spark, sf), 5, corpus_filter=flt,
                                  id_col="vec_id", exclude_self=True)


@register("search_result_frame", sql=f"""
SELECT t.query_id, CAST(t.id AS VARCHAR) AS id, d.text AS content, round(t.distance, 6) AS distance,
       t.rank, d.source AS filename, d.lang AS file_type
FROM ({sql_topk(5)}) t JOIN documents d ON d.doc_id = t.id""")
def q_search_result_frame(spark, sf):
    """Hits with content and flattened metadata, id as text."""
    docs = table(spark, sf, "documents")
    return S.search_result_frame(topk_all(spark, sf, 5), docs, "doc_id", "text",
                                 {"filename": "source", "file_type": "lang"})


SQL_GATE = f"""
  WITH best AS (
    SELECT query_id, min(distance) AS d FROM ({SQL_PAIRS}) p GROUP BY query_id)
  SELECT e.vec_id AS query_id, e.label AS label,
         coalesce(b.d <= {GATE_T}, FALSE) AS gate_allowed, b.d AS best_distance,
         CASE WHEN b.d IS NULL THEN 'no chunks returned'
              WHEN b.d > {GATE_T} THEN 'best_distance ' || printf('%.4f', b.d) || ' > threshold {GATE_T!r}'
              ELSE 'best_distance ' || printf('%.4f', b.d) || ' <= threshold {GATE_T!r}' END AS gate_reason
  FROM embeddings e LEFT JOIN best b ON b.query_id = e.vec_id"""


def gate_all(spark, sf, t=GATE_T):
    e = table(spark, sf, "embeddings")
    pol = DEFAULT_POLICY.with_(distance_threshold=t)
    g = G.relevance_gate(emb_queries(spark, sf), e, pol, id_col="vec_id", exclude_self=True)
    return g.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")


@register("relevance_gate", sql=f"""
SELECT query_id, gate_allowed, round(best_distance, 6) AS best_distance, gate_reason FROM ({SQL_GATE})""")
def q_relevance_gate(spark, sf):
    """G1: top-1 distance per query, verdict at 0.62, reason text with 4 dp."""
    return gate_all(spark, sf).select("query_id", "gate_allowed", "best_distance", "gate_reason")


@register("gate_policy", sql=f"""
SELECT query_id, gate_allowed,
       CASE WHEN NOT gate_allowed THEN 'relevance_gate:out_of_scope' END AS refused_reason,
       FALSE AS bypassed
FROM ({SQL_GATE})""")
def q_gate_policy(spark, sf):
    """Refusal when the gate fails and refuse_when_no_context is on."""
    g = gate_all(spark, sf)
    return G.gate_policy(g, DEFAULT_POLICY).select("query_id", "gate_allowed", "refused_reason", "bypassed")


@register("gate_distance_probe", sql=f"""
SELECT label, count(*) AS n_queries, count(best_distance) AS n_with_distance,
       round(min(best_distance), 6) AS min_distance,
       round(quantile_cont(best_distance, 0.5), 6) AS p50_distance,
       round(quantile_cont(best_distance, 0.9), 6) AS p90_distance,
       round(max(best_distance), 6) AS max_distance
FROM ({SQL_GATE}) GROUP BY label""")
def q_gate_distance_probe(spark, sf):
    """Best-distance distribution per label group."""
    return G.gate_distance_probe(gate_all(spark, sf), "label")


@register("gate_threshold_sweep", sql=f"""
WITH g AS (SELECT label % 2 = 0 AS on_topic, best_distance FROM ({SQL_GATE})),
t(threshold) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in SWEEP)})
SELECT t.threshold,
       count(*) FILTER (WHERE on_topic AND NOT coalesce(best_distance <= t.threshold, FALSE)) AS false_refusals,
       count(*) FILTER (WHERE NOT on_topic AND coalesce(best_distance <= t.threshold, FALSE)) AS false_passes,
       count(*) FILTER (WHERE on_topic) AS n_on, count(*) FILTER (WHERE NOT on_topic) AS n_off,
       coalesce((SELECT max(best_distance) FROM g WHERE on_topic) >=
                (SELECT min(best_distance) FROM g WHERE NOT on_topic), FALSE) AS groups_overlap
FROM g, t GROUP BY t.threshold""")
def q_gate_threshold_sweep(spark, sf):
    """False refusals / passes per threshold; even labels are on-topic."""
    g = gate_all(spark, sf).withColumn("on_topic", F.col("label") % 2 == 0)
    return G.gate_threshold_sweep(g, "on_topic", SWEEP)


def ivf(spark, sf):
    """The IVF index of this embeddings snapshot (opened if already built)."""
    import os
    from railyard.operators.ann import ann_index_open_or_build
    p = os.path.join(sf, "embeddings.parquet")
    snap = f"{os.path.abspath(p)}@{os.path.getmtime(p)}" if os.path.exists(p) else p
    return ann_index_open_or_build(table(spark, sf, "embeddings"), snap, id_col="vec_id")


@register("ann_index_build")
def q_ann_index_build(spark, sf):
    """E5: k-means IVF cells (square root of the rows) written partitioned by cell; rows-only."""
    from railyard.operators.ann import ann_index_build
    return ann_index_build(table(spark, sf, "embeddings"), id_col="vec_id").frame(spark).select(
        "vec_id", "cell")


@register("ann_index_cover", sql="SELECT vec_id, 1 AS n_cells, true AS inside FROM embeddings")
def q_ann_index_cover(spark, sf):
    """E5: every row lies in one cell of the index, within the cell's radius."""
    index = ivf(spark, sf)
    cells = spark.createDataFrame([(i, [float(x) for x in c], float(r)) for i, (c, r) in
                                   enumerate(zip(index.centroids, index.radii))], "cell int, centroid array<double>, radius double")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - cosine_distance("embedding", "centroid"))))
    rows = index.frame(spark).join(F.broadcast(cells), "cell").withColumn("inside", angle <= F.col("radius") + 1e-6)  # sqrt(rows) cells
    return rows.groupBy("vec_id").agg(F.count("*").alias("n_cells"), F.bool_and("inside").alias("inside"))


@register("ann_topk_dropped", sql=f"""
SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({sql_topk(5)})""")
def q_ann_topk_dropped(spark, sf):
    """E5: after the index is dropped the same search reads the flat rows."""
    from dataclasses import replace
    from railyard.operators.ann import ann_index_drop, ann_topk
    index = replace(ivf(spark, sf))
    ann_index_drop(index)
    return without_self(ann_topk(index, emb_queries(spark, sf), 6))


def _ann(spark, sf, all_cells=False, pruned=False):
    from railyard.operators.ann import ann_topk, ann_topk_pruned
    index = ivf(spark, sf)
    a = (ann_topk_pruned(index, emb_queries(spark, sf), 6) if pruned
         else ann_topk(index, emb_queries(spark, sf), 6, len(index.centroids) if all_cells else None))
    return without_self(a)


def without_self(a):
    """The 5 nearest of 6 without the self match, which the exact search excludes."""
    a = a.filter(F.col("query_id") != F.col("id")).drop("rank")
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc())
    return a.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)


@register("ann_topk")
def q_ann_topk(spark, sf):
    """Approximate top-5 probing as many cells as the build measured; rows-only (see ann_recall)."""
    return _ann(spark, sf)


@register("ann_topk_all_cells", sql=f"""
SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({sql_topk(5)})""")
def q_ann_topk_all_cells(spark, sf):
    """E6 probing every cell: must equal the exact search."""
    return _ann(spark, sf, all_cells=True)


@register("ann_topk_pruned", sql=f"""
SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({sql_topk(5)})""")
def q_ann_topk_pruned(spark, sf):
    """E6 with exact bounds from cell radii: equals the exact search."""
    return _ann(spark, sf, pruned=True)


@register("ann_distances", sql="""
SELECT vec_id AS query_id, 5 AS n_hits, 0 AS n_wrong_distance, 0 AS n_out_of_order FROM embeddings""")
def q_ann_distances(spark, sf):
    """Hits of the approximate search per query, those whose distance is not
    that of their vectors, and those nearer than the hit before them."""
    e = table(spark, sf, "embeddings")
    hits = _ann(spark, sf)
    a, b = (e.select(F.col("vec_id").alias(i), F.col("embedding").alias(v)) for i, v in (("query_id", "__a"), ("id", "__b")))
    full = hits.join(a, "query_id").join(b, "id")
    wrong = F.abs(F.col("distance") - cosine_distance("__a", "__b")) > 1e-9
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "distance")))  # at most 5
    out = full.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count(F.when(wrong, 1)).alias("n_wrong_distance"),
                                       by_rank.alias("r"))
    return out.withColumn("n_out_of_order", F.expr(
        "size(filter(sequence(1, size(r)), i -> i > 1 AND element_at(r, i).distance < element_at(r, i - 1).distance))")).drop("r")


@register("ann_recall")
def q_ann_recall(spark, sf):
    """recall@5 of the IVF search against the exact search."""
    from railyard.operators.ann import recall_at_k
    r = recall_at_k(_ann(spark, sf), topk_all(spark, sf, 5))
    return r.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("mean_recall"),
                 F.min("recall").alias("min_recall"))

"""Registered block, chunking and ingest queries.

``pages`` gives HTML blocks with headings; ``documents`` gives line blocks
(no headings).  The DuckDB oracle writes the greedy packing as a recursive
CTE over blocks in order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.operators import chunking as C
from railyard.plans import sqlfrag as Q
from railyard.plans.ingest import ingest_documents
from railyard.plans.q_tables import _CLASSIFY_SQL, doc_files
from railyard.plans.registry import register
from railyard.policy import DEFAULT_POLICY
from railyard.sources.chunk_table import classify_files
from railyard.sources.tables import table

SMALL_LIMIT = 512


def _clean_sql(x: str) -> str:
    t = f"regexp_replace({x}, {Q.q(C.TAG_RE)}, ' ', 'g')"
    for ent, ch in C.ENTITIES:
        t = f"replace({t}, {Q.q(ent)}, {Q.q(ch)})"
    return f"trim(regexp_replace({t}, {Q.q(C.SPACE_RE)}, ' ', 'g'))"


SQL_BODY = r"""regexp_replace(html,
  '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>', ' ', 'g')"""
SQL_BLOCK_RE = (r"'(?i)<(/?[a-z][a-z0-9]*)\b[^>]*>((?:[^<]+|</?(?:a|abbr|b|br|cite|code|del|em|font|i|img|ins|kbd|label|"
                r"mark|q|s|samp|small|span|strong|sub|sup|time|u|var|wbr)\b[^>]*>)*)'")
SQL_PAGE_BLOCKS = f"""
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::BIGINT AS pos,
         CASE WHEN tag = 'title' THEN 'title' WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'heading'
              WHEN tag = 'li' THEN 'list_item' ELSE 'paragraph' END AS kind,
         CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS level, text
  FROM (
    SELECT page_id AS doc_id, lower(unnest(regexp_extract_all(body, {SQL_BLOCK_RE}, 1))) AS tag,
           unnest(regexp_extract_all(body, {SQL_BLOCK_RE}, 2)) AS raw,
           generate_subscripts(regexp_extract_all(body, {SQL_BLOCK_RE}, 1), 1) AS idx
    FROM (SELECT page_id, '<p>' || regexp_replace({SQL_BODY}, '<([^a-zA-Z/]|$)', '&lt;\\1', 'g') AS body FROM pages)
  ), LATERAL (SELECT {_clean_sql('raw')} AS text)
  WHERE length(text) > 0"""

SQL_LINE_BLOCKS = """
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::BIGINT AS pos,
         'paragraph' AS kind, CAST(NULL AS INTEGER) AS level, text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
           generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)
  WHERE length(trim(text)) > 0"""

_WP = "(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def sql_headed(blocks_sql: str) -> str:
    cols = []
    for n in range(1, 7):
        isn = f"kind = 'heading' AND level = {n}"
        cols.append(f"max(CASE WHEN {isn} THEN pos END) OVER {_WP} AS p{n}")
        cols.append(f"last_value(CASE WHEN {isn} THEN text END IGNORE NULLS) OVER {_WP} AS t{n}")
    valid = []
    for n in range(1, 7):
        shallower = ", ".join(["-1"] + [f"coalesce(p{m}, -1)" for m in range(1, n)])
        own = f"(kind <> 'heading' OR {n} < level)"
        valid.append(f"CASE WHEN p{n} IS NOT NULL AND p{n} > greatest({shallower}) AND {own} THEN t{n} END")
    heads = "list_filter([" + ", ".join(valid) + "], lambda x: x IS NOT NULL)"
    return f"""
  SELECT doc_id, pos, kind, level, text, {heads} AS headings,
         coalesce(max(CASE WHEN kind = 'heading' THEN pos END) OVER
                  (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)::BIGINT
           AS group_pos
  FROM (SELECT *, {', '.join(cols)} FROM ({blocks_sql}))"""


def sql_chunks_ctes(headed_sql: str, limit: int) -> str:
    """CTEs ending in ``ch(doc_id, group_pos, chunk_no, headings, raw_tokens,
    n_blocks, raw_text)``; to be placed after ``WITH RECURSIVE``."""
    w = 4 * limit
    return f"""
  hd AS ({headed_sql}),
  pc0 AS (SELECT *, unnest(generate_series(0, greatest(1, ceil(length(text) / {w}))::BIGINT - 1)) AS sub
          FROM hd WHERE kind IN ('paragraph', 'list_item')),
  pc AS (SELECT doc_id, group_pos, headings, pos, sub, substr(text, sub * {w} + 1, {w}) AS text,
                greatest(1, floor(length(substr(text, sub * {w} + 1, {w})) / 4))::BIGINT AS tokens FROM pc0),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_pos ORDER BY pos, sub) AS rn FROM pc),
  walk AS (
    SELECT doc_id, group_pos, rn, 0::BIGINT AS chunk_no, tokens AS s FROM b WHERE rn = 1
    UNION ALL
    SELECT b.doc_id, b.group_pos, b.rn,
           CASE WHEN w.s + b.tokens > {limit} AND w.s > 0 THEN w.chunk_no + 1 ELSE w.chunk_no END,
           CASE WHEN w.s + b.tokens > {limit} AND w.s > 0 THEN b.tokens ELSE w.s + b.tokens END
    FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.group_pos = w.group_pos AND b.rn = w.rn + 1),
  ch AS (SELECT b.doc_id, b.group_pos, w.chunk_no, first(b.headings) AS headings,
                sum(b.tokens)::BIGINT AS raw_tokens, count(*) AS n_blocks,
                string_agg(b.text, chr(10) ORDER BY b.pos, b.sub) AS raw_text
         FROM b JOIN walk w USING (doc_id, group_pos, rn) GROUP BY 1, 2, 3)"""


def _ctx_sql(max_tokens: int) -> str:
    ctx = "CASE WHEN len(headings) > 0 THEN array_to_string(headings, chr(10)) || chr(10) || raw_text ELSE raw_text END"
    over = f"greatest(1, floor(length({ctx}) / 4)) > {max_tokens}"
    return (f"{over} AS fell_back, CASE WHEN {over} THEN raw_text ELSE {ctx} END AS content, "
            f"greatest(1, floor(length(CASE WHEN {over} THEN raw_text ELSE {ctx} END) / 4))::BIGINT AS contextualized_tokens")


def page_blocks(spark, sf):
    return C.extract_blocks(table(spark, sf, "pages"))


def doc_blocks(spark, sf):
    return C.line_blocks(table(spark, sf, "documents"))


@register("extract_blocks", sql=SQL_PAGE_BLOCKS)
def q_extract_blocks(spark, sf):
    """A3: title, headings with level, paragraphs, list items in reading order."""
    return page_blocks(spark, sf)


@register("malformed_pages", sql=f"""
SELECT count(*) AS n_pages, count(*) FILTER (coalesce(html, '') = '') AS n_empty,
       count(*) FILTER (regexp_matches({SQL_BODY}, '(?i)<(!--|script\\b|style\\b|/?[a-z][^<>]*(<|$))')) AS n_malformed
FROM pages""")
def q_malformed_pages(spark, sf):
    """A3: pages without text or with markup that breaks off."""
    return C.malformed_pages(table(spark, sf, "pages"))


@register("attach_headings", sql=f"""
SELECT doc_id, pos, kind, array_to_string(headings, ' > ') AS headings, group_pos
FROM ({sql_headed(SQL_PAGE_BLOCKS)})""")
def q_attach_headings(spark, sf):
    """Ancestor headings per block (deeper levels reset by a shallower heading)."""
    h = C.attach_headings(page_blocks(spark, sf))
    return h.select("doc_id", "pos", "kind", F.array_join("headings", " > ").alias("headings"), "group_pos")


@register("pack_chunks", sql=f"""
WITH RECURSIVE {sql_chunks_ctes(sql_headed(SQL_LINE_BLOCKS), SMALL_LIMIT)}
SELECT doc_id, group_pos, chunk_no, raw_tokens, n_blocks, md5(raw_text) AS raw_md5 FROM ch""")
def q_pack_chunks(spark, sf):
    """Greedy packing of document lines under a 512-token limit."""
    ch = C.pack_chunks(C.attach_headings(doc_blocks(spark, sf)), SMALL_LIMIT)
    return ch.select("doc_id", "group_pos", "chunk_no", "raw_tokens", "n_blocks", F.md5("raw_text").alias("raw_md5"))


@register("contextualize", sql=f"""
WITH RECURSIVE {sql_chunks_ctes(sql_headed(SQL_PAGE_BLOCKS), SMALL_LIMIT)}
SELECT doc_id, group_pos, chunk_no, {_ctx_sql(DEFAULT_POLICY.chunk_max_tokens)} FROM ch""")
def q_contextualize(spark, sf):
    """Headings above the raw text of page chunks; raw text when too long."""
    ch = C.pack_chunks(C.attach_headings(page_blocks(spark, sf)), SMALL_LIMIT)
    c = C.contextualize(ch, DEFAULT_POLICY.chunk_max_tokens)
    return c.select("doc_id", "group_pos", "chunk_no", "fell_back", "content", "contextualized_tokens")


@register("chunk_index", sql=f"""
WITH RECURSIVE {sql_chunks_ctes(sql_headed(SQL_PAGE_BLOCKS), SMALL_LIMIT)}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY group_pos, chunk_no) - 1)::BIGINT AS chunk_index,
       group_pos, chunk_no FROM ch""")
def q_chunk_index(spark, sf):
    """0-based chunk index per page."""
    ch = C.chunk_index(C.pack_chunks(C.attach_headings(page_blocks(spark, sf)), SMALL_LIMIT))
    return ch.select("doc_id", "chunk_index", "group_pos", "chunk_no")


@register("chunk_stats", sql=f"""
WITH RECURSIVE {sql_chunks_ctes(sql_headed(SQL_LINE_BLOCKS), SMALL_LIMIT)},
cx AS (SELECT doc_id, raw_tokens, {_ctx_sql(DEFAULT_POLICY.chunk_max_tokens)} FROM ch)
SELECT doc_id, count(*) AS n_chunks, sum(raw_tokens)::BIGINT AS raw_tokens, max(raw_tokens)::BIGINT AS max_chunk_tokens,
       count(*) FILTER (WHERE fell_back) AS n_fell_back FROM cx GROUP BY doc_id""")
def q_chunk_stats(spark, sf):
    """Chunks, tokens and fall-backs per document."""
    ch = C.contextualize(C.pack_chunks(C.attach_headings(doc_blocks(spark, sf)), SMALL_LIMIT),
                         DEFAULT_POLICY.chunk_max_tokens)
    return C.chunk_stats(ch)


@register("ingest_documents", sql=f"""
WITH RECURSIVE f AS ({_CLASSIFY_SQL}),
{sql_chunks_ctes(sql_headed(SQL_LINE_BLOCKS.replace('FROM documents)', 'FROM documents WHERE doc_id IN (SELECT doc_id FROM f WHERE accepted))')), DEFAULT_POLICY.chunk_pack_limit)},
ix AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY group_pos, chunk_no) - 1)::BIGINT AS chunk_index,
              {_ctx_sql(DEFAULT_POLICY.chunk_max_tokens)} FROM ch)
SELECT sha256(CAST(f.doc_id AS VARCHAR) || ':' || CAST(ix.chunk_index AS VARCHAR)) AS id, f.filename, f.file_type, ix.chunk_index,
       ix.raw_tokens AS raw_token_count, ix.contextualized_tokens AS contextualized_token_count,
       md5(ix.raw_text) AS contents_md5
FROM ix JOIN f USING (doc_id)""")
def q_ingest_documents(spark, sf):
    """Accepted document files -> chunks with deterministic ids, embedded
    (hashed TF on the contextualised text), raw text stored."""
    files = classify_files(doc_files(spark, sf), "path").withColumn("file_path", F.col("path"))
    out = ingest_documents(doc_blocks(spark, sf), files)
    return out.select("id", "filename", "file_type", "chunk_index", "raw_token_count",
                      "contextualized_token_count", F.md5("contents").alias("contents_md5"))

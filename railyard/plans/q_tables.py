"""Registered table, metadata and cache queries.

``documents`` plays the chunk table (``doc_id`` as id, ``text`` as contents,
``source`` as filename, ``lang`` as file type); ``events`` plays time-keyed
logs (``user_id`` as cache key / session, ``props`` as JSON metadata).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.functions.text import ts_text
from railyard.operators import embed as D
from railyard.operators import metadata as M
from railyard.plans.registry import register
from railyard.session import scratch_path
from railyard.sources import chunk_table as CT
from railyard.sources.tables import table

_EXT = {"en": ".pdf", "fr": ".DOCX", "de": ".txt", "es": ".md"}
_EXT_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXT.items()) + " ELSE '' END"


def doc_files(spark, sf):
    d = table(spark, sf, "documents")
    ext = F.coalesce(F.element_at(F.create_map(*[x for k, v in _EXT.items() for x in (F.lit(k), F.lit(v))]),
                                  F.col("lang")), F.lit(""))
    return d.select("doc_id", F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"),
                                       F.col("doc_id").cast("string"), ext).alias("path"))


_FILES_SQL = f"SELECT doc_id, '/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || {_EXT_SQL} AS path FROM documents"
_CLASSIFY_SQL = f"""
  SELECT doc_id, path, regexp_extract(path, '([^/\\\\]*)$', 1) AS filename,
         lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS file_type,
         lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) IN ('.pdf', '.docx') AS accepted,
         CASE WHEN NOT lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) IN ('.pdf', '.docx')
              THEN 'suffix ''' || lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) || ''' is not one of .pdf, .docx' END AS error
  FROM ({_FILES_SQL})"""


@register("scan_documents", sql=_CLASSIFY_SQL)
def q_scan_documents(spark, sf):
    """A2: suffix allowlist (lower-cased) on derived file paths; rejects are rows."""
    return CT.classify_files(doc_files(spark, sf), "path").select(
        "doc_id", "path", "filename", "file_type", "accepted", "error")


TEXT_FILES = (".txt",)


@register("scan_files", sql="""
SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS source, '.txt' AS file_type, true AS accepted,
       (sum(strlen(coalesce(text, '')) + 1))::BIGINT AS n_bytes, NULL::VARCHAR AS error
FROM documents WHERE lang IN ('en', 'de') GROUP BY 1
UNION ALL SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__'), '.gz', false, NULL,
       'suffix ''.gz'' is not one of .txt'
FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de') GROUP BY 1""")
def q_scan_files(spark, sf):
    """A2: the documents written as files, plain or compressed by language and in a
    folder per source, are scanned as binary files; compressed ones are rejected."""
    d = table(spark, sf, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("value"))
    plain = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    base = scratch_path(spark, "scan")
    for part, codec in ((plain, "none"), (~plain, "gzip")):
        d.filter(part).drop("lang").write.mode("append").partitionBy("source").option("compression", codec).text(base)
    files = CT.scan_documents(spark, base, TEXT_FILES)
    source = F.regexp_extract("path", r"/source=([^/]*)/", 1)
    return (files.groupBy(source.alias("source"), "file_type", "accepted", "error")
            .agg(F.sum(F.when(F.col("accepted"), F.col("length"))).alias("n_bytes")))


def _updates(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))
    base = d.withColumn("version", F.lit(1))
    upd = d.filter(F.col("id") % 7 == 0).select("id", F.concat("contents", F.lit(" [v2]")).alias("contents"),
                                                   F.lit(2).alias("version"))
    upd3 = d.filter(F.col("id") % 14 == 0).select("id", F.concat("contents", F.lit(" [v3]")).alias("contents"),
                                                     F.lit(3).alias("version"))
    new = d.filter(F.col("id") % 11 == 0).select((-F.col("id") - 1).alias("id"), "contents",
                                                    F.lit(1).alias("version"))
    return base, upd.unionByName(upd3).unionByName(new)


@register("upsert_chunks", sql="""
WITH base AS (SELECT doc_id AS id, text AS contents, 1 AS version FROM documents),
upd AS (SELECT doc_id AS id, text || ' [v2]' AS contents, 2 AS version FROM documents WHERE doc_id % 7 = 0
        UNION ALL SELECT doc_id, text || ' [v3]', 3 FROM documents WHERE doc_id % 14 = 0
        UNION ALL SELECT -doc_id - 1, text, 1 FROM documents WHERE doc_id % 11 = 0),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) rn FROM upd) WHERE rn = 1)
SELECT id, version, md5(contents) AS contents_md5 FROM base WHERE id NOT IN (SELECT id FROM win)
UNION ALL SELECT id, version, md5(contents) FROM win""")
def q_upsert_chunks(spark, sf):
    """A4: replace by id, latest version within the batch wins, new ids appended."""
    base, upd = _updates(spark, sf)
    out = CT.upsert_chunks(base, upd, "id", "version")
    return out.select("id", "version", F.md5("contents").alias("contents_md5"))


@register("delete_chunks_by_ids", sql="""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def q_delete_by_ids(spark, sf):
    """A5: delete the ids listed in another table (anti-join)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    ids = table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return CT.delete_chunks(d, ids=ids).select(F.col("id").alias("doc_id"))


@register("delete_all_chunks", sql="SELECT count(*) AS n_before, 0 AS n_after FROM documents")
def q_delete_all(spark, sf):
    """A5: delete everything; the emptied table keeps its schema."""
    d = table(spark, sf, "documents")
    left = CT.delete_chunks(d, delete_all=True)
    assert left.schema == d.schema
    return d.agg(F.count("*").alias("n_before")).withColumn("n_after", left.select(F.count("*")).scalar())


@register("delete_chunks_by_metadata", sql="""
SELECT doc_id FROM documents WHERE NOT (source = 'src3' AND lang = 'fr') OR source IS NULL OR lang IS NULL""")
def q_delete_by_metadata(spark, sf):
    """A5: delete rows whose metadata equals {filename: src3, file_type: fr}."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.create_map(F.lit("filename"), F.col("source"), F.lit("file_type"), F.col("lang")).alias("metadata"))
    return CT.delete_chunks(d, metadata_filter={"filename": "src3", "file_type": "fr"}, key="doc_id").select("doc_id")


_WEEK_SQL = "strftime(make_timestamp((epoch_us(ts) // 604800000000) * 604800000000), '%Y-%m-%d')"


def _written_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props",
                                           F.col("ts").alias("created_at"))
    path = scratch_path(spark, "events_by_week")
    CT.write_partitioned_chunk_table(ev, path, "created_at")
    return spark.read.parquet(path)


@register("partitioned_chunk_table", sql=f"""
SELECT {_WEEK_SQL} AS week_bucket, count(*) AS n FROM events GROUP BY 1""")
def q_partitioned(spark, sf):
    """Table written partitioned by 7-day bucket; rows per partition."""
    t = _written_events(spark, sf)
    return t.groupBy(F.col("week_bucket").cast("string").alias("week_bucket")).agg(F.count("*").alias("n"))


@register("filter_time_range", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'""")
def q_filter_time_range(spark, sf):
    """[start, end) on the partitioned table; the bucket predicate prunes
    partitions (PartitionFilters in the scan)."""
    t = _written_events(spark, sf)
    return t.filter(CT.bucket_range_filter("2024-01-05 00:00:00", "2024-01-12 00:00:00")).select(
        "event_id", ts_text("created_at").alias("ts"))


@register("ingest_ledger", sql=f"""
WITH f AS ({_CLASSIFY_SQL}),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      WHERE length(trim(line)) > 0 GROUP BY doc_id)
SELECT substr(sha256(CAST(f.doc_id AS VARCHAR)), 1, 16) AS job_id, f.filename,
       CASE WHEN f.accepted THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
       CASE WHEN f.accepted THEN coalesce(c.n, 0) END::BIGINT AS chunks_ingested,
       CASE WHEN NOT f.accepted THEN f.error END AS error
FROM f LEFT JOIN c USING (doc_id)""")
def q_ingest_ledger(spark, sf):
    """One ledger row per file; chunks = non-blank lines of accepted files."""
    files = CT.classify_files(doc_files(spark, sf), "path")
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(
        F.length(F.trim("line")) > 0)
    return CT.ingest_ledger(files, lines, "doc_id")


@register("list_documents", sql="""
SELECT source AS filename, lang AS file_type, count(*) AS chunk_count FROM documents
GROUP BY 1, 2 ORDER BY 1 NULLS LAST, 2 NULLS LAST""")
def q_list_documents(spark, sf):
    """Chunk count per (filename, file_type)."""
    return CT.list_documents(table(spark, sf, "documents"), "source", "lang")


@register("expand_metadata", sql="""
SELECT CAST(event_id AS VARCHAR) AS id, event_type, json_extract_string(props, '$.k') AS k FROM events""")
def q_expand_metadata(spark, sf):
    """B1: JSON metadata keys as columns, id as text."""
    ev = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", "props")
    return M.expand_metadata(ev, ["k"], "props", "id", json=True)


@register("filter_metadata", sql="""
SELECT doc_id FROM documents WHERE (source = 'src1' AND lang = 'en') OR lang = 'de'""")
def q_filter_metadata(spark, sf):
    """B2: list of equality dicts (OR of ANDs) on a metadata map."""
    d = table(spark, sf, "documents")
    m = F.create_map(F.lit("filename"), F.col("source"), F.lit("file_type"), F.col("lang"))
    return d.filter(M.filter_metadata(m, [{"filename": "src1", "file_type": "en"}, {"file_type": "de"}])).select("doc_id")


@register("filter_predicates", sql="""
SELECT event_id FROM events
WHERE (TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AND event_type = 'click')
   OR TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 5""")
def q_filter_predicates(spark, sf):
    """(k > 50 & event_type == click) | (k <= 5) on metadata."""
    ev = table(spark, sf, "events")
    m = F.map_concat(M.parse_metadata("props"), F.create_map(F.lit("event_type"), F.col("event_type")))
    tree = (M.Pred("k", ">", 50) & M.Pred("event_type", "==", "click")) | M.Pred("k", "<=", 5)
    return ev.filter(tree.column(m)).select("event_id")


@register("uuid1_timestamp", sql="""
WITH u AS (
  SELECT event_id, ts, epoch_us(ts) * 10 + 122192928000000000 AS ticks FROM events),
t AS (SELECT event_id, ts,
        printf('%08x', ticks & 4294967295) || '-' || printf('%04x', (ticks >> 32) & 65535) || '-' ||
        printf('%04x', ((ticks >> 48) & 4095) | 4096) || '-' || printf('%04x', (event_id & 16383) | 32768) || '-' ||
        printf('%012x', event_id * 7919 + 17) AS uuid FROM u)
SELECT event_id, uuid,
       strftime(make_timestamp(((('0x' || substr(uuid, 16, 3) || substr(uuid, 10, 4) || substr(uuid, 1, 8))::UBIGINT
                                 - 122192928000000000) // 10)::BIGINT), '%Y-%m-%d %H:%M:%S.%f') AS uuid_time
FROM t""")
def q_uuid1_timestamp(spark, sf):
    """Version-1 UUIDs made from event times, then their time read back."""
    ev = table(spark, sf, "events")
    u = ev.select("event_id", M.uuid1_from_time("ts", F.col("event_id"), F.col("event_id") * 7919 + 17).alias("uuid"))
    return u.select("event_id", "uuid", ts_text(M.uuid1_timestamp("uuid")).alias("uuid_time"))


@register("compose_faq_record", sql="""
SELECT q.conv_id, q.turn, 'Question: ' || q.text || chr(10) || 'Answer: ' || a.text AS contents,
       'cat' || CAST(q.conv_id % 5 AS VARCHAR) AS category,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(q.conv_id) + to_minutes(q.turn), '%Y-%m-%dT%H:%M:%S.%f') AS created_at
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""")
def q_compose_faq_record(spark, sf):
    """question/answer pairs (user turn + next assistant turn) as seed records."""
    c = table(spark, sf, "conversations")
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("answer"))
    pairs = q.join(a, ["conv_id", "turn"]).withColumn(
        "category", F.concat(F.lit("cat"), (F.col("conv_id") % 5).cast("string"))).withColumn(
        "created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
        .cast("timestamp_ntz"))
    out = M.compose_faq_record(pairs, keep=("conv_id", "turn"))
    return out.select("conv_id", "turn", "contents", F.col("metadata")["category"].alias("category"),
                      F.col("metadata")["created_at"].alias("created_at"))


@register("embed_batch", sql="""
SELECT doc_id, 64 AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '^\\s+$') THEN 0.0 ELSE 1.0 END AS norm
FROM documents""")
def q_embed_batch(spark, sf):
    """Built-in hashed-TF encoder over every document (unit norm, 64 dims)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = D.embed_batch(d, "text", dim=64)
    nrm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("doc_id", F.size("embedding").cast("long").alias("dim"), nrm.alias("norm"))


def _letter_encoder():
    """A user encoder that SQL can follow: length and vowels of a text."""
    def encode(texts):
        return [[float(len(t)), *[float(t.count(c)) for c in "aeiou"]] for t in texts]
    return encode


def _letters_sql(text: str) -> str:
    return ", ".join([f"length({text}) AS e0"] + [f"length({text}) - length(replace({text}, '{c}', '')) AS e{i}"
                                                  for i, c in enumerate("aeiou", 1)])


def _components():
    return [F.col("embedding")[i].cast("long").alias(f"e{i}") for i in range(6)]


@register("embed_batch_encoder", sql=f"SELECT doc_id, {_letters_sql('t')} FROM "
          "(SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS t FROM documents)")
def q_embed_batch_encoder(spark, sf):
    """D1 with a user encoder: the whole vector of every document."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return D.embed_batch(d, "text", _letter_encoder()).select("doc_id", *_components())


@register("embedding_cache_vectors", sql=f"""
WITH c AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, c.s IS NOT NULL AS cache_hit, {', '.join(f"CASE WHEN c.s IS NULL THEN e{i} ELSE -e{i} END AS e{i}" for i in range(6))}
FROM (SELECT doc_id, text, {_letters_sql('t')} FROM
      (SELECT doc_id, text, replace(coalesce(text, ''), chr(10), ' ') AS t FROM documents)) d
LEFT JOIN c ON c.s = sha256(d.text)""")
def q_cache_vectors(spark, sf):
    """The vectors of hits and misses; those in the cache are negated, so it
    shows where each came from."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    seed = D.embed_batch(d.filter(F.col("doc_id") % 3 == 0), "text", _letter_encoder()).select(
        F.lit("letters").alias("model"), F.sha2("text", 256).alias("text_sha"),
        F.transform("embedding", lambda x: -x).alias("embedding"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("set_at"))
    res, _new = D.embedding_cache_lookup(d, seed, "letters", "text", _letter_encoder())
    return res.select("doc_id", "cache_hit", *_components())


@register("embedding_cache_lookup", sql="""
SELECT doc_id, sha256(text) AS text_sha,
       sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS cache_hit
FROM documents""")
def q_cache_lookup(spark, sf):
    """Hits by (model, sha256(text)); the cache holds every third document."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    seed = D.embed_batch(d.filter(F.col("doc_id") % 3 == 0), "text").select(
        F.lit("hashtf64").alias("model"), F.sha2("text", 256).alias("text_sha"), "embedding",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("set_at"))
    res, _new = D.embedding_cache_lookup(d, seed, "hashtf64", "text")
    return res.select("doc_id", "text_sha", "cache_hit")


_LAST_SET_SQL = """
SELECT 'm' AS model, CAST(user_id AS VARCHAR) AS text_sha, max(ts) AS last_set FROM events GROUP BY user_id"""


@register("embedding_cache_expire", sql=f"""
SELECT text_sha, strftime(last_set, '%Y-%m-%d %H:%M:%S.%f') AS last_set FROM ({_LAST_SET_SQL})
WHERE last_set + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-29 12:00:00'""")
def q_cache_expire(spark, sf):
    """D3: entries alive at 2024-01-29 12:00 with a 24 h TTL from the last set."""
    ev = table(spark, sf, "events").select(F.lit("m").alias("model"), F.col("user_id").cast("string").alias("text_sha"),
                                           F.col("ts").alias("set_at"))
    out = D.embedding_cache_expire(ev, "2024-01-29 12:00:00", 86400)
    return out.select("text_sha", ts_text("last_set").alias("last_set"))


@register("embedding_cache_evict", sql=f"""
SELECT text_sha FROM ({_LAST_SET_SQL})
WHERE text_sha NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def q_cache_evict(spark, sf):
    """Evict the keys listed in another table."""
    ev = table(spark, sf, "events").select(F.lit("m").alias("model"), F.col("user_id").cast("string").alias("text_sha"),
                                           F.col("ts").alias("set_at"))
    cache = ev.groupBy("model", "text_sha").agg(F.max("set_at").alias("set_at"))
    keys = table(spark, sf, "labels").filter(F.col("toxic") == 1).select(
        F.lit("m").alias("model"), F.col("doc_id").cast("string").alias("text_sha"))
    return D.embedding_cache_evict(cache, keys).select("text_sha")


@register("corrupt_entry_recovery", sql="""
SELECT event_id, NOT json_valid(CASE WHEN event_type = 'error' THEN substr(props, 1, 5) ELSE props END) AS corrupt
FROM events""")
def q_corrupt_entry(spark, sf):
    """Truncated payloads (error events) decode to null and count as misses."""
    ev = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.substring("props", 1, 5)).otherwise(F.col("props")).alias("payload"))
    return D.decode_payload(ev, "payload", "map<string,int>").select("event_id", "corrupt")


@register("embedding_cache_replay", sql="""
WITH RECURSIVE r AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT user_id, rn, event_id, ts, ts + INTERVAL 86400 SECOND AS exp, FALSE AS cache_hit FROM r WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.rn, r.event_id, r.ts,
         CASE WHEN r.ts >= w.exp THEN r.ts + INTERVAL 86400 SECOND ELSE w.exp END, r.ts < w.exp
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, cache_hit FROM walk""")
def q_cache_replay(spark, sf):
    """Request log replay, a hit never extends the entry (TTL 24 h)."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    out = D.embedding_cache_replay(ev, "user_id", "ts", "event_id", 86400)
    return out.select("user_id", "event_id", ts_text("ts").alias("ts"), "cache_hit")


@register("read_faq_csv", sql="""
SELECT q.text AS question, a.text AS answer, 'cat' || CAST(q.conv_id % 5 AS VARCHAR) AS category
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""")
def q_read_faq_csv(spark, sf):
    """A1: question/answer pairs written by Spark as a ``;`` CSV with header
    (quoted multi-line fields), read back with the FAQ reader."""
    from railyard.sources.tables import read_faq_csv, write_faq_csv
    c = table(spark, sf, "conversations")
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("answer"))
    pairs = q.join(a, ["conv_id", "turn"]).withColumn(
        "category", F.concat(F.lit("cat"), (F.col("conv_id") % 5).cast("string")))
    path = scratch_path(spark, "faq_csv")
    write_faq_csv(pairs, path)
    return read_faq_csv(spark, path)

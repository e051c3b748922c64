"""Registered queries of the llm operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.session import ship_package

from . import (chat_mask, crosspoly_ann, curriculum, dedup_tree, merkle_manifest, ngram_join, pii_tagger, quality_gam,
               secret_scan, spelling_groups, spm_bpe, token_store, toxicity)
from .common import documents, prepare

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A conversation whose texts are control strings.
ODD_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_crosspoly_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return crosspoly_ann.nearest(vectors, F.col("id") % 100 == 0)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(documents(spark, sf_dir), TOKENIZER))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_tree.exact_dedup(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.find_personal_data(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op7_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_mask.read_back(chat_mask.format_conversations(given.union(odd), TOKENIZER))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.curriculum_mix(documents(spark, sf_dir)).drop("text_key")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(documents(spark, sf_dir), labels)


def op10_spm_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_bpe.encode_documents(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.tamper_report(documents(spark, sf_dir))


def op13_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gam.score_documents(documents(spark, sf_dir), labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_crosspoly_ann, op2_token_store, op3_exact_dedup, op4_ngram_join, op5_personal_data, op6_secret_scan,
        op7_chat_masks, op8_curriculum_mix, op9_toxicity, op10_spm_bpe, op11_spelling_groups, op12_merkle_manifest, op13_quality_gam)}


_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
sums AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY no_source, src),
sources AS (SELECT *, row_number() OVER (ORDER BY no_source, src) - 1 AS nth FROM sums),
ranked AS (
  SELECT *, [4.0, 1.0, 1.0][nth % 3 + 1]::DOUBLE AS w0, [2.0, 1.0, 3.0][nth % 3 + 1]::DOUBLE AS w1,
         (w0 + w1) / 2 AS weight, source_size * 2.0::DOUBLE AS cap, cap / weight AS fills_at FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fills_at, no_source, src
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fills_at, no_source, src
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM ranked),
targets AS (
  SELECT no_source, src, source_size, w0, w1, weight, least(cap, coalesce(
         first_value(CASE WHEN own_level <= fills_at THEN own_level END IGNORE NULLS) OVER (ORDER BY fills_at, no_source,
         src ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, cap)) AS target FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.w0, t.w1, t.weight, t.target, (sum(size) OVER (PARTITION BY s.no_source, s.src
         ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begin_at,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS passes
  FROM sized s JOIN targets t USING (no_source, src)),
shares AS (
  SELECT *, passes * size + greatest(0, least(size, round(target - passes * source_size)::BIGINT - begin_at)) AS taken,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, begin_at / target) ELSE 0 END AS v,
         sqrt(w0 * w0 + (w1 - w0) * 2 * weight * v) AS root FROM placed)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN w0 + root > 0 THEN weight * 2 * v / (w0 + root) ELSE 0 END END AS position
FROM shares
"""

_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32_sql(byte_list: str) -> str:
    """Unsigned crc32 of a list of bytes, by the table ``t.steps`` of _CRC_TABLE."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), "
            "lambda c, b: xor(c >> 8, t.steps[(xor(c, b) & 255) + 1])), 4294967295)")


#: crc32 of every byte: eight halvings, each odd one xored with the polynomial.
_CRC_TABLE = """t AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i))"""
#: UTF-8 bytes of a text of code points below 2048.
_BYTES = """flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)]::BIGINT[]
         ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END))"""

_SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, {_crc32_sql(_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM per_doc, t),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
         ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
skips AS (
  SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
cuts AS (
  SELECT word, n, left(word, i) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM skips x JOIN cuts y ON x.a = y.a AND x.b = y.b
  UNION SELECT y.word, y.n, x.word, x.n FROM skips x JOIN cuts y ON x.a = y.a AND x.b = y.b),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n, n
  FROM near GROUP BY word, n),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
         CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT w.word, w.next, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' "
             f"|| CAST({v} AS VARCHAR) END" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
  SELECT doc_id, lang, {_leaf_sql('text')} AS leaf, CASE WHEN doc_id IS NOT NULL
         AND {_crc32_sql(_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '')"))} % 3 = 0
         THEN {_leaf_sql(_LOWER_SQL.format('text'))} ELSE {_leaf_sql('text')} END AS used FROM documents, t),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS size FROM hashed),
sub AS (
  SELECT tree, 0 AS level, pos, leaf AS h, size FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (size + 7) // 8
  FROM sub WHERE size > 1 GROUP BY tree, level, pos // 8, size),
subroots AS (SELECT tree, h AS subroot, level AS height, count(*) OVER () AS size FROM sub WHERE size = 1),
top AS (
  SELECT 0 AS level, tree AS pos, subroot AS h, size FROM subroots
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (size + 7) // 8
  FROM top WHERE size > 1 GROUP BY level, pos // 8, size),
path AS (
  SELECT l.tree, l.pos, s.level AS step, s.pos AS place, s.h, s.pos = l.pos // (8 ** s.level)::BIGINT AS own
  FROM leaves l JOIN sub s ON s.tree = l.tree AND s.size > 1
       AND s.pos // 8 = l.pos // (8 ** (s.level + 1))::BIGINT
  UNION ALL
  SELECT l.tree, l.pos, r.height + s.level, s.pos, s.h, s.pos = l.tree // (8 ** s.level)::BIGINT
  FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN top s ON s.size > 1
       AND s.pos // 8 = l.tree // (8 ** (s.level + 1))::BIGINT),
proof AS (
  SELECT tree, pos, sha256(coalesce(string_agg(h, '' ORDER BY step, place) FILTER (NOT own), '')) AS proof_sha256,
         max(step) + 1 AS steps FROM path GROUP BY tree, pos),
fold AS (
  SELECT tree, pos, 0 AS step, used AS h FROM leaves
  UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(string_agg(CASE WHEN p.own THEN f.h ELSE p.h END, '' ORDER BY p.place))
  FROM fold f JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND p.step = f.step GROUP BY f.tree, f.pos, f.step, f.h)
SELECT l.doc_id, l.leaf, r.subroot, g.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = g.h AS verified
FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN top g ON g.size = 1
     LEFT JOIN proof p ON p.tree = l.tree AND p.pos = l.pos
     JOIN fold f ON f.tree = l.tree AND f.pos = l.pos AND f.step = coalesce(p.steps, 0)
"""


def oracle_sql() -> dict[str, str]:
    """None for op1 (approximate), op2 and op10 (tokenizers), op5, op6, op9 and
    op13 (models and scanners) and op7 (token offsets): tests hold those against
    brute force, round trips or held-out labels."""
    return {"op3_exact_dedup": _DEDUP_SQL, "op4_ngram_join": _JOIN_SQL, "op8_curriculum_mix": _MIX_SQL,
            "op11_spelling_groups": _SPELLING_SQL, "op12_merkle_manifest": _MERKLE_SQL}

"""Block extraction and chunking.

* ``extract_blocks`` turns HTML pages into ``(doc_id, pos, kind, level,
  text)`` rows in one JVM pass: scripts, styles and comments are cut, block
  tags are matched with ``regexp_extract_all`` (a block's text runs until the
  next non-inline tag, so unclosed ``<p>`` and ``<li>`` are handled), inline
  tags are dropped and the common named entities decoded.
* Headings are carried by windows over ``pos`` (C1).
* Packing (C2) is the greedy rule "add the next block while the sum of token
  counts stays within the limit, never across a heading".  Prefix sums tell
  for every block where the next chunk would begin if one began here; the
  chunks that do begin are the orbit of the group's first block
  (``functions.orbit``).  A heading group of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from railyard.functions.orbit import orbit
from railyard.functions.scan import join_same, running
from railyard.functions.text import Counter, token_count
from railyard.session import materialized

# ---------------------------------------------------------------------------
# Inline tags and entities of the HTML block extractor.
# ---------------------------------------------------------------------------
INLINE_TAGS = ("a", "abbr", "b", "br", "cite", "code", "del", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
               "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"),
            ("&hellip;", "…"), ("&amp;", "&"))

# A block is any tag that is not inline, with the text up to the next such tag.
# Java's regex engine recurses once per repetition of a group, so whole runs are
# consumed per repetition (possessive, no backtracking).
BLOCK_RE = (r"(?i)<(/?[a-z][a-z0-9]*)\b[^>]*+>((?:[^<]++|</?(?:" + "|".join(INLINE_TAGS) + r")\b[^>]*+>)*+)")
# Scripts, styles, comments and declarations; no other region is cut.
DROP_RE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>"
# A "<" that opens no tag is text.
BARE_RE = r"<([^a-zA-Z/]|$)"
# What is left of a page whose markup breaks off: an open region or an open tag.
BROKEN_RE = r"(?i)<(!--|script\b|style\b|/?[a-z][^<>]*(<|$))"
TAG_RE = r"<[^>]*>"
SPACE_RE = r"\s+"


def clean_inline(col: Column) -> Column:
    """Drop inline tags, decode entities (``&amp;`` last), squeeze blanks."""
    t = F.regexp_replace(col, TAG_RE, " ")
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(t, SPACE_RE, " "))


def page_body(html: Column) -> Column:
    return F.regexp_replace(html, DROP_RE, " ")


def extract_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A3: ``(doc_id, pos, kind, level, text)``; kind is title, heading,
    list_item or, for the text of all other elements and between them,
    paragraph; level 1-6 for headings; empty blocks dropped and positions
    renumbered in reading order. Pages without text give no rows."""
    body = F.concat(F.lit("<p>"), F.regexp_replace(page_body(F.col(html_col)), BARE_RE, "&lt;$1"))
    tags = F.regexp_extract_all(body, F.lit(BLOCK_RE), 1)
    texts = F.regexp_extract_all(body, F.lit(BLOCK_RE), 2)
    blocks = F.filter(F.arrays_zip(F.transform(tags, lambda t: F.lower(t)).alias("tag"),
                                   F.transform(texts, lambda x: clean_inline(x)).alias("text")),
                      lambda b: F.length(b["text"]) > 0)
    df = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks).alias("pos", "b"))
    tag = F.col("b.tag")
    heading = tag.rlike("^h[1-6]$")
    kind = (F.when(tag == "title", "title").when(heading, "heading")
            .when(tag == "li", "list_item").otherwise("paragraph"))
    level = F.when(heading, F.substring(tag, 2, 1).cast("int"))
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"),
                     level.alias("level"), F.col("b.text").alias("text"))


def malformed_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A3: number of pages, of pages without markup text (null or empty) and of
    pages whose markup breaks off inside a tag, comment, script or style."""
    empty = F.coalesce(F.length(html_col) == 0, F.lit(True))
    return pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(empty).alias("n_empty"),
                     F.count_if(page_body(F.col(html_col)).rlike(BROKEN_RE)).alias("n_malformed"))


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without markup: each non-blank line is a paragraph block."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.length(F.trim(x)) > 0)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("pos", "text")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.lit("paragraph").alias("kind"),
        F.lit(None).cast("int").alias("level"), "text")


def attach_headings(blocks: DataFrame) -> DataFrame:
    """Every block gets ``headings`` (ancestor heading texts, outermost
    first) and ``group_pos`` (position of the latest heading, -1 if none).
    A heading at level n closes every open heading at level >= n."""
    w = (Window.partitionBy("doc_id").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, -1))
    df = blocks
    for n in range(1, 7):
        is_n = (F.col("kind") == "heading") & (F.col("level") == n)
        df = (df.withColumn(f"__p{n}", F.max(F.when(is_n, F.col("pos"))).over(w))
              .withColumn(f"__t{n}", F.last(F.when(is_n, F.col("text")), ignorenulls=True).over(w)))
    valid = []
    for n in range(1, 7):
        shallower = [F.coalesce(F.col(f"__p{m}"), F.lit(-1)) for m in range(1, n)]
        ok = F.col(f"__p{n}").isNotNull()
        if shallower:
            ok = ok & (F.col(f"__p{n}") > F.greatest(F.lit(-1), *shallower))
        # a heading's own ancestors are the strictly shallower levels
        own = F.when(F.col("kind") == "heading", F.lit(n) < F.col("level")).otherwise(F.lit(True))
        valid.append(F.when(ok & own, F.col(f"__t{n}")))
    heads = F.filter(F.array(*valid), lambda x: x.isNotNull())
    gpos = F.max(F.when(F.col("kind") == "heading", F.col("pos"))).over(
        Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("headings", heads).withColumn("group_pos", F.coalesce(gpos, F.lit(-1)).cast("long"))
            .drop(*[f"__p{n}" for n in range(1, 7)], *[f"__t{n}" for n in range(1, 7)]))


def sized(blocks: DataFrame, limit: int) -> DataFrame:
    """``blocks`` with ``piece_tokens``, the default token counts of the pieces that
    :func:`split_oversized` cuts: what packing has to know before it needs a text."""
    width = 4 * limit
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / width)).cast("int")
    return blocks.withColumn("piece_tokens", F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: token_count(F.substr(F.col("text"), i * width + 1, F.lit(width)))))


def split_oversized(blocks: DataFrame, limit: int, counter: Counter = None) -> DataFrame:
    """Blocks whose token count alone exceeds the limit are cut into pieces
    of ``4 * limit`` characters (the default token rule is ``len // 4``).

    ``counter``: see :func:`railyard.functions.text.token_count`; a piece that
    another counter finds longer than the limit is a chunk of its own."""
    width = 4 * limit
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / width)).cast("int")
    return (blocks.withColumn("sub", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("text", F.substr(F.col("text"), F.col("sub") * width + 1, F.lit(width)))
            .withColumn("tokens", token_count("text", counter)))


_GROUP = ["doc_id", "group_pos"]


def _next_starts(pieces: DataFrame, limit: int) -> DataFrame:
    """``doc_id, group_pos, pos, sub, idx, next``: the place of each piece in its
    group and of the first piece that no longer fits a chunk begun at it.

    ``next`` is a range window over the tokens before a piece. Windows are cut
    into stretches of ``limit * 64`` tokens, and the pieces in the first ``limit``
    tokens of a stretch also stand, as a look-ahead, in the one before."""
    order = [F.col("pos"), F.col("sub")]
    bucket = F.floor(F.col("pos") / F.lit(1024)).cast("long")
    df = running(pieces.select(*_GROUP, "pos", "sub", "tokens"), _GROUP, order, bucket,
                 {"idx": ("count", F.lit(1)), "__end": ("sum", F.col("tokens"))})
    width = 64 * limit
    df = (df.withColumn("idx", F.col("idx") - 1).withColumn("__from", F.col("__end") - F.col("tokens"))
          .withColumn("__cut", F.floor(F.col("__from") / F.lit(width)).cast("long")))
    ahead = (F.col("__cut") > 0) & (F.col("__from") % width <= limit)
    df = df.withColumn("__own", F.explode(F.when(ahead, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    df = df.withColumn("__cut", F.when(F.col("__own"), F.col("__cut")).otherwise(F.col("__cut") - 1))
    w = Window.partitionBy(*_GROUP, "__cut").orderBy("__from").rangeBetween(0, limit)
    df = df.withColumn("__m", F.max(F.struct("idx", "__end")).over(w)).filter("__own")
    # the last piece that begins within the limit opens the next chunk, unless it fits too: then it is the last of all
    nxt = F.when(F.col("__m.__end") > F.col("__from") + limit, F.col("__m.idx")).otherwise(F.col("__m.idx") + 1)
    return df.select(*_GROUP, "pos", "sub", "idx", F.greatest(nxt, F.col("idx") + 1).alias("next"))


def _dealt(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The join of ``pieces`` with the chunk numbers of ``places`` where null ids are
    equal, as a window over both: they meet by document, and stay so for all that
    follows by document or chunk, which a null-safe join does not offer."""
    key = ["doc_id", "pos", "sub"]
    both = pieces.unionByName(places, allowMissingColumns=True).repartition("doc_id")
    held = F.collect_list("chunk_no").over(Window.partitionBy(*key))  # one, unless ids repeat
    return (both.withColumn("__held", held).filter(F.col("chunk_no").isNull())
            .withColumn("chunk_no", F.explode("__held")).drop("__held"))


def pack_chunks(blocks: DataFrame, limit: int, counter: Counter = None) -> DataFrame:
    """Greedy packing of content blocks within (doc, heading group).

    Input: output of :func:`attach_headings`.  Output: one row per chunk with
    ``doc_id, group_pos, chunk_no, headings, raw_text, raw_tokens, n_blocks``.
    ``counter`` counts the tokens of a text (default: ``approx_tokens``).
    Blocks that :func:`sized` counted are placed by these counts, without their text.

    Texts meet their places by document, once; the chunks are made where they lie.
    """
    content = blocks.filter(F.col("kind").isin("paragraph", "list_item"))
    pieces = split_oversized(content.drop("piece_tokens"), limit, counter)
    slim = pieces
    if counter is None and "piece_tokens" in blocks.columns:
        slim = content.select(*_GROUP, "pos", F.posexplode("piece_tokens").alias("sub", "tokens"))
    places = materialized(_next_starts(slim, limit), "pack-places")
    chunks = orbit(places, _GROUP).select(*_GROUP, F.col("nth").alias("chunk_no"),
                                          F.explode(F.sequence(F.col("idx"), F.col("next") - 1)).alias("idx"))
    places = join_same(places.drop("next"), chunks, [*_GROUP, "idx"]).select("doc_id", "pos", "sub", "chunk_no")
    assigned = _dealt(pieces, places)
    return (assigned.groupBy("doc_id", "group_pos", "chunk_no").agg(
        F.first("headings").alias("headings"),
        F.array_sort(F.collect_list(F.struct("pos", "sub", "text"))).alias("__parts"),  # at most limit tokens
        F.sum("tokens").cast("long").alias("raw_tokens"),
        F.count("*").alias("n_blocks"))
        .withColumn("raw_text", F.array_join(F.transform("__parts", lambda p: p["text"]), "\n"))
        .drop("__parts"))


def contextualize(chunks: DataFrame, max_tokens: int, counter: Counter = None) -> DataFrame:
    """Embed text = headings above the raw text; falls back to the raw
    text when that exceeds ``max_tokens``."""
    ctx = F.concat_ws("\n", F.array_join(F.coalesce("headings", F.array().cast("array<string>")), "\n"), "raw_text")
    ctx = F.when(F.size(F.coalesce("headings", F.array())) > 0, ctx).otherwise(F.col("raw_text"))
    df = chunks.withColumn("__ctx", ctx).withColumn("fell_back", token_count("__ctx", counter) > max_tokens)
    return (df.withColumn("content", F.when(F.col("fell_back"), F.col("raw_text")).otherwise(F.col("__ctx")))
            .withColumn("contextualized_tokens", token_count("content", counter)).drop("__ctx"))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """0-based chunk index per document in reading order."""
    w = Window.partitionBy("doc_id").orderBy("group_pos", "chunk_no")
    return chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, raw tokens (sum, max) and fall-backs per document."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum("raw_tokens").cast("long").alias("raw_tokens"),
        F.max("raw_tokens").cast("long").alias("max_chunk_tokens"),
        F.count(F.when(F.col("fell_back"), 1)).alias("n_fell_back"))

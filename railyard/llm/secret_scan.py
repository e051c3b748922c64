"""Secret scan: fixed patterns and sliding-window entropy (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: kind: (Java pattern, group whose length counts, least length). Matching is
#: leftmost and non-overlapping; a match that is too short is dropped, not retried.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so a shorter run never hides one
}
KINDS = [*BASE, "entropy"]
#: Strings that may be secrets, and those of them that are known not to be.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = (
    r"[0-9/_=+-]+",                                             # dates, numbers, rulers
    r"[A-Za-z/_=+-]+",                                          # words, paths, slugs without digits
    r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",      # UUIDs
    r"[A-Za-z]+([/_-][A-Za-z0-9]{1,12})+",                      # paths and slugs of short words
    r"(?i).*(example|placeholder|changeme|x{6,}).*",
)
WINDOW = 20
#: Least bits per character over a window, by the class its characters belong to.
BITS = {"hex": 3.0, "lower": 3.5, "upper": 3.5, "base64": 3.75}


def _matches(text: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """(id, key, kind, start, finish) of the accepted matches of one pattern.

    The matches and the pieces between them come from one pass each; the
    running sum of their lengths gives the offsets in code points.
    """
    hits = (text.filter(F.col("text").rlike(pattern))
            .select("id", "key", F.posexplode(F.arrays_zip(
                F.split("text", pattern).alias("gap"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("part"))))
            .select("id", "key", "pos", F.length("col.gap").alias("gap"), F.col("col.hit").alias("hit"),
                    F.length("col.hit").alias("n"), F.length("col.part").alias("part"))
            .filter("hit is not null").dropDuplicates(["id", "key", "pos"]))
    seen = Window.partitionBy("id", "key").orderBy("pos")
    finish = F.sum(F.col("gap") + F.col("n")).over(seen)
    return (hits.withColumn("finish", finish).filter(F.col("part") >= least)
            .select("id", "key", F.lit(kind).alias("kind"), (F.col("finish") - F.col("n")).alias("start"),
                    "finish", "hit"))


def _gain(count: str) -> Column:
    """c log2 c less (c-1) log2 (c-1): what one more character adds to the sum."""
    c = F.col(count)
    return c * F.log2(c) - F.when(c > 1, (c - 1) * F.log2(c - 1)).otherwise(0.0)


def entropy_spans(candidates: DataFrame, window: int = WINDOW, bits: dict = BITS) -> DataFrame:
    """Spans of ``candidates`` (id, key, start, hit) whose windows are random enough.

    Every character is a row. A sliding frame per (candidate, character) counts
    its occurrences in the window that it enters and in the one that it leaves;
    the running sums of the two gains differ by the window's sum of c log2 c, so
    each window's entropy follows from the last one's by two counts. Classes, all
    with digits and letters: ``hex`` (0-9 and a-f or A-F, of one case), ``lower``
    and ``upper`` (digits and letters of that case only, as base 36 and base 32)
    and ``base64`` (digits with upper and lower case). The span runs from the
    first window that qualifies in any class to the last.
    """
    one = ["id", "key", "start"]
    chars = candidates.select(*one, F.posexplode(F.split("hit", "")).alias("pos", "ch")).filter("ch <> ''")
    same_char = Window.partitionBy(*one, "ch").orderBy("pos")
    order = Window.partitionBy(*one).orderBy("pos")
    frame = order.rowsBetween(1 - window, 0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)

    def inside(cond: str) -> Column:
        return F.sum(F.when(F.expr(cond), 1).otherwise(0)).over(frame)

    counted = (chars.withColumn("enters", F.count("ch").over(same_char.rangeBetween(1 - window, 0)))
               .withColumn("leaves", F.count("ch").over(same_char.rangeBetween(0, window - 1)))
               .withColumn("inflow", F.sum(_gain("enters")).over(upto))
               .withColumn("outflow", F.sum(_gain("leaves")).over(upto))
               .withColumn("gone", F.coalesce(F.lag("outflow", window).over(order), F.lit(0.0)))
               .withColumn("digits", inside("ch between '0' and '9'"))
               .withColumn("upper", inside("ch between 'A' and 'Z'"))
               .withColumn("lower", inside("ch between 'a' and 'z'"))
               .withColumn("hexes", inside("ch between '0' and '9' or ch between 'a' and 'f'"))
               .withColumn("heads", inside("ch between '0' and '9' or ch between 'A' and 'F'")))
    h = F.log2(F.lit(float(window))) - (F.col("inflow") - F.col("gone")) / window
    digits, lower, upper = (F.col(c) for c in ("digits", "lower", "upper"))
    one_case = (digits > 0) & (digits < window)
    hot = (one_case & ((F.col("hexes") == window) | (F.col("heads") == window)) & (h >= bits["hex"])
           | one_case & (digits + lower == window) & (h >= bits["lower"])
           | one_case & (digits + upper == window) & (h >= bits["upper"])
           | (digits > 0) & (lower > 0) & (upper > 0) & (h >= bits["base64"]))
    return (counted.filter(F.col("pos") >= window - 1).filter(hot).groupBy(*one)
            .agg((F.min("pos") - (window - 1)).alias("first"), (F.max("pos") + 1).alias("last"))
            .select("id", "key", F.lit("entropy").alias("kind"), (F.col("start") + F.col("first")).alias("start"),
                    (F.col("start") + F.col("last")).alias("finish")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 allowed=ALLOWED, window: int = WINDOW, bits: dict = BITS) -> DataFrame:
    """(id, key, kind, start, finish) of the secrets in whole texts; key is a
    hash of the text, so rows that repeat an id with another text stay apart.

    Base spans of the three patterns all stay; an entropy span is added where it
    overlaps none of them and its string is not on the allow list. Null and
    empty texts have none.
    """
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = None
    for kind, (pattern, group, least) in BASE.items():
        part = _matches(text, kind, pattern, group, least).drop("hit")
        base = part if base is None else base.unionByName(part)
    strings = _matches(text, "entropy", CANDIDATE, 0, window)
    for pattern in allowed:
        strings = strings.filter(~F.col("hit").rlike(f"^(?:{pattern})$"))
    spans = base.unionByName(entropy_spans(strings, window, bits))
    own = F.col("kind") == "entropy"
    begun = Window.partitionBy("id", "key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("id", "key").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    clash = ((F.coalesce(F.max(F.when(~own, F.col("finish"))).over(begun), F.lit(-1)) > F.col("start"))
             | (F.min(F.when(~own, F.col("start"))).over(ahead) < F.col("finish")))
    return (spans.withColumn("clash", F.coalesce(clash, F.lit(False)))
            .filter(~(own & F.col("clash"))).drop("clash"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex (base spans),
    n_entropy, base_sha256 and spans (kind:start:end by start, then kind)."""
    spans = secret_spans(docs, id_col, text_col, **how)
    nth = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    said = F.concat_ws(":", "kind", "start", "finish")
    found = spans.groupBy("id", "key").agg(
        F.sort_array(F.collect_list(F.struct("start", nth.alias("nth"), "finish", said.alias("said")))).alias("all"),
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in KINDS])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"))
    base = F.array_join(F.filter("all", lambda s: s["nth"] < len(KINDS))["said"], ",")
    none = F.lit("")
    return (rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["text_key"] == found["key"]), "left")
            .select("doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                    F.sha2(F.coalesce(base, none).cast("binary"), 256).alias("base_sha256"),
                    F.coalesce(F.array_join(F.col("all")["said"], ","), none).alias("spans")))

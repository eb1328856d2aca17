"""Quality rules: a hashed n-gram log-likelihood ratio between trusted text and the whole corpus, in built-in functions only.

Words and word pairs are hashed into BUCKETS buckets. The raw multinomial counts every distinct text of the corpus, the
trusted one every distinct text with a row labelled as good: however often a text was copied, no verdict changes. Smoothing is a fixed share of the trusted mass, so that the same rates give the
same ratios at any size, and an n-gram doesn't count as raw evidence against itself: one seen nowhere else says nothing.
A document's score is the mean log ratio over its n-grams, in thousandths; below THRESHOLD, or failing the base rules,
it is rejected. Every document is scored and decided by the same fixed rule.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, counted_broadcast, cut, table

BUCKETS = 1 << 16
#: Pseudo-counts as a share of the trusted ones, dealt as the raw corpus is.
PRIOR = 3.0
#: Mean log ratio in thousandths from which a document is kept.
THRESHOLD = -60
MIN_WORDS = 50
_WS = r"[\\x20\\x09-\\x0D]"
_STRIP = r"' \t\n\u000B\u000C\r'"

#: 64-bit hashes of the words of a text.
HASHES = rf"""transform(CASE WHEN length(trim(BOTH {_STRIP} FROM _text)) = 0 THEN cast(array() AS array<string>)
  ELSE split(trim(BOTH {_STRIP} FROM _text), '{_WS}+') END, w -> xxhash64(w))"""
GRAMS = f"""concat(transform(_h, x -> cast(x & {BUCKETS - 1} AS int)), CASE WHEN size(_h) > 1
  THEN transform(sequence(0, size(_h) - 2), i -> cast((_h[i] ^ shiftleft(_h[i + 1], 1)) & {BUCKETS - 1} AS int)) ELSE cast(array() AS array<int>) END)"""
WINDOWS = """CASE WHEN size(_h) > 2 THEN transform(sequence(0, size(_h) - 3), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2])) ELSE cast(array() AS array<bigint>) END"""
#: Positions of windows that occur twice or more, in order; sorting brings equal hashes together.
TWICE = """CASE WHEN size(array_distinct(_g)) = size(_g) THEN cast(array() AS array<int>) ELSE
  transform(array(sort_array(transform(_g, (x, i) -> named_struct('x', x, 'i', i)))), s ->
    sort_array(transform(filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].x = e.x)), e -> e.i)))[0] END"""
COVERED = """cast(coalesce(aggregate(_p, named_struct('at', -3, 'n', 0), (a, p) -> named_struct('at', p, 'n', a.n + least(3, p - a.at)), a -> a.n), 0) AS bigint)"""


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_h", F.expr(HASHES))


def distinct_texts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(text, good) of every distinct text; good where one of its rows is labelled so.

    Two hashes stand for a text. Texts that occur once stay where they are; those of copies are reduced before they are
    shuffled. Only where more digests than may be broadcast have copies are all texts shuffled.
    """
    some = cut(good.select(F.col("doc_id").cast("long").alias("_good")).filter("_good IS NOT NULL").distinct(), "trusted")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text"))
    keys = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit("2"), "text").alias("b")]
    copied = cut(own.select(*keys).groupBy("a", "b").count().filter("count > 1").select("a", "b"), "copied")
    rows = own.join(counted_broadcast(some), F.col("_id") == F.col("_good"), "left").select("text", F.col("_good").isNotNull().alias("good"), *keys)

    def once(rows):
        return rows.groupBy("a", "b").agg(F.first("text").alias("text"), F.bool_or("good").alias("good")).select("text", "good")

    if copied.count() > BROADCAST_ROWS:
        return once(rows)
    few = F.broadcast(copied)
    return rows.join(few, ["a", "b"], "left_anti").select("text", "good").unionAll(once(rows.join(few, ["a", "b"], "left_semi")))


def ratios(docs: DataFrame, good: DataFrame) -> list[int]:
    """A log ratio in thousandths for each bucket. good: doc_id of rows labelled as good. Empty inputs give zeros."""
    grams = hashed(distinct_texts(docs, good)).select("good", F.explode(F.expr(GRAMS)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good"))
    raw, good_n = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # at most BUCKETS rows
        raw[r[0]], good_n[r[0]] = r[1], r[2]
    all_raw, all_good = sum(raw), sum(good_n)
    if not all_good:
        return [0] * BUCKETS
    out = []
    for r, g in zip(raw, good_n, strict=True):
        others = max(r - 1, g)
        times = g / all_good / (others / all_raw) if others else 1.0
        # so scaled that the score of text a little off an even ratio is that ratio's log
        out.append(round(1000 * (1 + PRIOR) * math.log((times + PRIOR) / (1 + PRIOR))))
    return out


def measured(docs: DataFrame, weights: list[int]) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept."""
    names = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")]
    w = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded into one constant
    step = hashed(docs.select(*names)).select(*names, "_text", "_h", F.expr(WINDOWS).alias("_g"), F.expr(GRAMS).alias("_b"))
    step = step.select(*names, "_text", "_h", "_b", F.expr(TWICE).alias("_p"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda a, b: a + w[b])
    step = step.select(
        *names, F.size("_h").cast("long").alias("n_words"), F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), lines.alias("_lines"),
        F.expr(COVERED).alias("n_repeat_words"), (total / F.greatest(F.size("_b"), F.lit(1))).alias("score"))
    step = step.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD))


def good_rows(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def quality_rules(docs: DataFrame, good: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the base figures, score, base_failed, kept.

    Null texts have no words, so they fail the base rules; null ids are never trusted; repeated rows each get their
    row; without trusted rows every score is 0 and only the base rules reject; an empty table gives no rows.
    """
    return measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios(docs, good)).drop("text")


def keep_good(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    weights = ratios(docs, good)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text"))
    # a column that isn't deterministic keeps the filter above the figures: pushed below, they would be inlined into
    # it and worked out again for every element
    return measured(packed, weights).withColumn("_part", F.spark_partition_id()).filter("kept AND _part >= 0").select("_row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), good_rows(spark, sf_dir))

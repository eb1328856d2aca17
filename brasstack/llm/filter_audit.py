"""How filters interact: what each removes in every order, from one pass over the texts.

A document's mask has a bit for each filter that it fails. Counts of masks per part, at most 32, give the survivors of
every filter subset by a subset-zeta transform: f(S) sums the counts of all masks within S, and the survivors of
subset S are f of its complement. A step of an order is then a difference between two neighbouring subsets, for
documents and for labelled ones alike, so no order is ever applied to documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted_broadcast, cut, long_id, table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
MEASURES = ("n", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """(part, id, digest, mask): the filters A to D that a row fails as bits 0 to 3, and its text's SHA-256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), long_id().alias("id"), text.alias("t"))
    own = own.withColumn("inner", F.btrim("t", F.lit(WHITE)))
    own = own.withColumn("words", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", "[\\x20\\x09-\\x0D]+")))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    fails = (words < 200, 100 * distinct < 50 * words, 100 * capitals.cast("long") > 2 * F.length("t"), F.col("t").rlike("[#$%&*|]"))
    mask = sum((F.when(f, 1 << b).otherwise(0) for b, f in enumerate(fails)), F.lit(0))
    return own.select("part", "id", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part; filter E, bit 4, fails a text that a smaller id has too."""
    rows = cut(failures(docs), "failures")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first")
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality").cast("int") == 1).alias("good"), (F.col("toxic").cast("int") == 1).alias("toxic"))
    marked = marked.filter("id IS NOT NULL").groupBy("id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("good", "toxic")]).filter("good OR toxic")
    met = rows.join(counted_broadcast(cut(firsts, "firsts")), "digest", "left").select(
        "part", "id", F.col("mask").bitwiseOR(F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"))
    met = met.join(counted_broadcast(cut(marked, "marked")), "id", "left")
    flag = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return met.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), flag("good"), flag("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic): per part three arrays, which have at S what no filter of subset S removes."""
    entry = F.struct("mask", F.struct(*MEASURES))
    got = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # at most 32 entries
    at = F.sequence(F.lit(0), F.lit(ALL))

    def dense(k):
        return F.transform(at, lambda s: F.coalesce(F.try_element_at("m", s)[k], F.lit(0).cast("long"))).alias(k)

    def widened(k, bit):
        return F.transform(k, lambda x, s: F.when(s.bitwiseAND(bit) != 0, x + F.get(F.col(k), s.bitwiseXOR(bit))).otherwise(x))

    def complement(k):
        return F.transform(at, lambda s: F.get(F.col(k), s.bitwiseXOR(F.lit(ALL)))).alias(k)

    got = got.select("part", *map(dense, MEASURES))
    for b in range(len(FILTERS)):  # zeta: in round b each S with bit b takes over what S without it has
        got = got.withColumns({k: widened(k, 1 << b) for k in MEASURES})
    return got.select("part", *map(complement, MEASURES))


def _shapley(bit: int):
    """What the filter removes, summed over all orders: a subset of k others stands before it in k! (4-k)! of them."""
    rest = len(FILTERS) - 1
    terms = []
    for s in range(ALL + 1):
        if not s & bit:
            k = s.bit_count()
            terms.append(F.lit(factorial(k) * factorial(rest - k)) * (F.col("n")[s] - F.col("n")[s | bit]))
    return sum(terms[1:], terms[0])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty, a null source is the part '' together with empty ones; null ids count as larger than all
    others and equal among themselves, so they are never each other's smaller id; rows that repeat an id and a text
    have no smaller one either. Of repeated label rows any 1 counts; labels without id are left out. Long texts are
    read whole. An empty table has no parts and gives no rows; other columns are not read.
    """
    got = survivors(mask_counts(docs, labels))
    got = got.withColumn("all_orders", F.array(*[_shapley(1 << b) for b in range(len(FILTERS))]))
    # fixed by the number of filters: 120 orders, 5 steps each
    orders = got.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])))
    steps = orders.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).filter("letter <> ''")
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), F.lit(0), lambda acc, x: acc.bitwiseOR(bit(x)))
    steps = steps.withColumns({"nth": F.instr(F.lit(FILTERS), F.col("letter")) - 1, "bit": bit(F.col("letter")), "before": before})
    steps = steps.withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    lost = lambda k, s="before", t="after": F.get(F.col(k), F.col(s)) - F.get(F.col(k), F.col(t))
    steps = steps.withColumns({"none": F.lit(0), "others": F.lit(ALL).bitwiseXOR(F.col("bit")), "every": F.lit(ALL)})
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), F.get(F.col("n"), F.col("after")).alias("kept"), lost("n").alias("removed"),
        (lost("n", "none", "bit") - lost("n")).alias("redundant"), lost("n", "others", "every").alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get(F.col("all_orders"), F.col("nth")).alias("shapley"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask, good, toxic
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31
  AND len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
steps AS (SELECT filter_order, CAST(k AS int) AS step, bits[k] AS bit, CAST(list_sum(bits[1:k]) AS int) AS after FROM o, range(1, 6) g(k)),
r AS (SELECT part, filter_order, step, bit,
    CAST(coalesce(sum(n) FILTER (mask & after = 0), 0) AS bigint) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & (after - bit) = 0 AND mask & bit <> 0), 0) AS bigint) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & (after - bit) <> 0 AND mask & bit <> 0), 0) AS bigint) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS bigint) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & (after - bit) = 0 AND mask & bit <> 0), 0) AS bigint) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & (after - bit) = 0 AND mask & bit <> 0), 0) AS bigint) AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley FROM r
"""

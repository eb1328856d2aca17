"""Line dedup by a log-template tree, in built-in functions only.

A line's path in the tree has fixed depth: its token count and its first LEAD tokens, tokens with a digit being variable.
A leaf whose lines are all equal has that line as its template. In other leaves a token is constant at its position if
SHARE of the leaf's lines have it there; the others become <*>. A leaf of many templates has too few such tokens: while
they are less than CONSTANT of its tokens behind the leading ones, it is split by the tokens at one position, up to DEPTH
times: the position with the fewest different tokens of those where repeated ones make at least half. Where at least
CONSTANT of a line's tokens behind the leading ones, which are equal within a leaf, are constant in its part, the
generalised line is its template, else the line is its own. A template found in two or more documents recurs: its lines
are dropped but in the first document, by id and hash of the text, which together tell documents apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, back, cut, long_id, table

LEAD = 3
SHARE = 0.3
CONSTANT = 0.5
#: Most splits of a leaf, one after the other.
DEPTH = 5
#: Lines of fewer tokens recur only as they are, digits included.
MIN_TOKENS = 3
ANY = "<*>"


def _doc():
    """What tells documents apart; null ids stand as NO_ID."""
    return F.struct("id", "th")



def _tokens(m):
    return F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1


def _constant(m):
    """Share of a masked line's tokens that aren't variable."""
    return 1 - (F.length(m) - F.length(F.replace(m, F.lit(ANY), F.lit("")))) / (len(ANY) * _tokens(m))


def lines(docs: DataFrame) -> DataFrame:
    """(id, th, pos, m, n, leaf): every line but blank ones, the variable tokens of MIN_TOKENS or more masked if at least CONSTANT stay; th tells texts of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # worked out below the generator, once a text; most texts have single spaces only or no digits, so their lines needn't
    # be looked at for these
    own = docs.select(long_id().alias("id"), text.alias("text")).select(
        "id", "text", F.xxhash64("text").alias("th"), F.col("text").rlike(r"[\x09\x0B-\x0D]|\x20\x20").alias("_wide"), F.col("text").rlike("[0-9]").alias("_digits"))
    parts = own.select("id", "th", "_wide", "_digits", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    single = F.when(F.col("_wide"), F.regexp_replace("line", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("line"))
    flat = parts.withColumn("m", F.trim(single))
    masked = F.transform(F.array(F.regexp_replace("m", r"(?<!\S)[^\s0-9]*+[0-9]\S*+", ANY)), lambda x: F.when(_constant(x) >= CONSTANT, x).otherwise(F.col("m")))[0]
    masked = F.when(F.col("_digits") & F.col("m").rlike("[0-9]") & (_tokens(F.col("m")) >= MIN_TOKENS), masked).otherwise(F.col("m"))
    # the partition number keeps the filter above the masking, which it would repeat below
    flat = flat.select("id", "th", "pos", masked.alias("m"), F.spark_partition_id().alias("_part"))
    flat = flat.withColumn("n", _tokens(F.col("m"))).filter((F.col("m") != "") & (F.col("_part") >= 0)).drop("_part")
    return flat.withColumn("leaf", F.xxhash64("n", F.substring_index("m", " ", LEAD)))


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str, n_right: int) -> DataFrame:
    """Broadcasts the right side only if its counted rows are few; else both are shuffled, hot keys split by adaptive execution."""
    return left.join(F.broadcast(right) if n_right <= BROADCAST_ROWS else right, on, how)


def _placed(rows: DataFrame, first: int) -> DataFrame:
    """(part, i, token, k, total, n): how often a token stands at position i, from `first` on, of a part's lines."""
    tokens = rows.select("part", "total", "n", F.posexplode(F.split("m", " ")).alias("i", "token")).filter(F.col("i") >= first)
    return tokens.groupBy("part", "i", "token").agg(F.count(F.lit(1)).alias("k"), F.max("total").alias("total"), F.max("n").alias("n"))


def _often():
    return (F.col("k") >= 2) & (F.col("k") >= SHARE * F.col("total")) & (F.col("token") != ANY)


def _parted(own: DataFrame) -> DataFrame:
    """own (leaf, total, m, n, ...) with part, and total for it: leaves of many templates in parts.

    All parts that are still open are split at once, so the rounds are DEPTH at most, however many parts there are.
    """
    rows, settled = own.withColumn("part", F.col("leaf")), None
    for _ in range(DEPTH):
        word = F.col("token") != ANY
        places = _placed(rows, LEAD).groupBy("part", "i").agg(
            F.max("total").alias("total"), F.max("n").alias("n"), F.sum(F.when(_often(), F.col("k")).otherwise(0)).alias("fixed"),
            F.sum(F.when(word & (F.col("k") >= 2), F.col("k")).otherwise(0)).alias("again"), F.count_if(word).alias("kinds"))
        able = (F.col("kinds") >= 2) & (2 * F.col("again") >= F.col("total"))
        parts = places.groupBy("part").agg(F.sum("fixed").alias("fixed"), F.max("total").alias("total"), F.max("n").alias("n"), F.min(F.when(able, F.struct("kinds", "i"))).alias("by"))
        wanting = F.col("by").isNotNull() & (F.col("fixed") < CONSTANT * F.col("total") * (F.col("n") - LEAD))
        split = cut(parts.filter(wanting).select("part", F.col("by.i").alias("at")), "split")
        if not (n_split := split.count()):
            break
        rest = _meet(rows, split.select("part"), ["part"], "left_anti", n_split)
        settled = rest if settled is None else settled.unionByName(rest)
        token = F.split("m", " ")[F.col("at")]
        inner = cut(_meet(rows.drop("total"), split, ["part"], "inner", n_split).withColumn("part", F.xxhash64("part", "at", token)).drop("at"), "parts")
        sizes = cut(inner.groupBy("part").agg(F.count(F.lit(1)).alias("total")), "sizes")
        rows = cut(_meet(inner, sizes, ["part"], "inner", sizes.count()), "parted")
    return rows if settled is None else rows.unionByName(settled)


def templates(docs: DataFrame) -> DataFrame:
    """(id, th, pos, template) of every line that lines() gives."""
    found = lines(docs)
    plain = cut(found.select("id", "th", "pos", "leaf", F.xxhash64("leaf", "m").alias("template")), "lines")
    leaves = plain.groupBy("leaf").agg(F.min("template").alias("a"), F.max("template").alias("b"), F.min(_doc()).alias("c"), F.max(_doc()).alias("d"), F.count(F.lit(1)).alias("total"))
    mixed = cut(leaves.filter("a <> b AND c <> d").select("leaf", "total"), "mixed")
    n_mixed = mixed.count()
    if not n_mixed:
        return plain.drop("leaf")
    rest = _meet(plain, mixed.select("leaf"), ["leaf"], "left_anti", n_mixed).drop("leaf")
    own = cut(_parted(cut(_meet(found, mixed, ["leaf"], "inner", n_mixed), "variable")), "own")
    # at most 1 / SHARE tokens at a position
    spots = _placed(own, 0).groupBy("part", "i").agg(F.collect_set(F.when(_often(), F.col("token"))).alias("tokens"))
    trees = cut(spots.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "tokens"))).alias("spots")), "trees")
    met = own.join(trees, "part").withColumn("t", F.split("m", " "))
    kept = F.transform("t", lambda x, i: F.when(F.array_contains(F.col("spots")[i]["tokens"], x), x).otherwise(F.lit(ANY)))
    met = met.select("id", "th", "pos", "leaf", "m", "n", kept.alias("skeleton"))
    # lines of LEAD tokens or fewer are equal within a leaf, so none gets here
    share = F.size(F.filter("skeleton", lambda x, i: (x != ANY) & (i >= LEAD))) / F.greatest(F.col("n") - LEAD, F.lit(1))
    own_t = F.when(share >= CONSTANT, F.xxhash64("leaf", F.array_join("skeleton", " "))).otherwise(F.xxhash64("leaf", "m"))
    return rest.unionByName(met.select("id", "th", "pos", own_t.alias("template")))


def dropped(docs: DataFrame) -> DataFrame:
    """(id, th, lost): positions of the lines that go, for the texts that lose any."""
    placed = cut(templates(docs), "templates")
    recurring = placed.groupBy("template").agg(F.min(_doc()).alias("first"), F.max(_doc()).alias("last")).filter("first <> last").select("template", "first")
    gone = placed.join(cut(recurring, "recurring"), "template").filter("id <> first.id OR th <> first.th")
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("lost"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, dropped (line numbers from 0), text without those lines.

    Null texts are empty texts of one line; null ids count as larger than all others and, as other ids that repeat, are
    told apart by a hash of the text, in whose order they follow; rows that repeat an id and a text are one document and lose
    the same lines; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    own = docs.select(long_id().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = own.withColumn("th", F.xxhash64("text")).join(cut(dropped(docs), "lost"), ["id", "th"], "left")
    keep = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("lost"), i))
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    return met.select(
        back(F.col("id")).alias("doc_id"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("lost", ","), F.lit("")).alias("dropped"), text.alias("text"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))

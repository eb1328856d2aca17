"""Quotas, ids, validation, pricing and other row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from brasstack.scratch import cut


def quota(items: DataFrame, quotas: dict[str, int], domains: list[str], target: int, order: str = "ord") -> DataFrame:
    """The first of each domain up to its quota, then the rest domain by domain, cut to target; column place from 1."""
    rn = F.row_number().over(Window.partitionBy("domain").orderBy(order))
    share = F.coalesce(*[F.when(F.col("domain") == d, F.lit(n)) for d, n in quotas.items()], F.lit(0))
    quota_at = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(quotas)], F.lit(len(quotas)))
    domain_at = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(domains)], F.lit(len(domains)))
    ranked = items.withColumn("_rn", rn).filter(F.col("_rn") <= target)
    ranked = ranked.withColumn("_pass", F.when(F.col("_rn") <= share, 0).otherwise(1))
    ranked = ranked.withColumn("_dom", F.when(F.col("_pass") == 0, quota_at).otherwise(domain_at))
    top = ranked.orderBy("_pass", "_dom", "_rn").limit(target)
    # at most target rows are left
    return top.withColumn("place", F.row_number().over(Window.orderBy("_pass", "_dom", "_rn"))).drop("_rn", "_pass", "_dom")


def number(df: DataFrame, order: list[str]) -> DataFrame:
    """df with position, from 1 in a total order, without moving all rows to one task.

    The range-partitioned rows are written once, each with its place in its partition; sizes of partitions and the
    result are both read from there, because a second range exchange would sample other bounds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(ranged, "ranged").withColumn("_p", F.shiftright("_at", 33))  # the number of the partition is above, the place in it below
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each of n partitions
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(before), "_p").withColumn("position", position).drop("_p", "_at", "_before")


def seed_id(position: Column) -> Column:
    return F.format_string("SEED_%03d", position)


def instance_id(seed: Column, k: Column) -> Column:
    return F.concat(F.lit("MI_"), F.split_part(seed, F.lit("_"), F.lit(2)), F.lit("_"), F.format_string("%02d", k))


def problem_id(instance: Column) -> Column:
    # fixed value: how ids begin
    return F.concat(F.lit("JR-1K-"), F.split_part(instance, F.lit("_"), F.lit(2)), F.lit("-"), F.split_part(instance, F.lit("_"), F.lit(3)))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with errors (names of the rules a row breaks, null counts as broken) and valid."""
    errors = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda e: e.isNotNull())
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def require_some(checked: DataFrame, show: int = 10) -> DataFrame:
    """The valid rows; raises with the first errors only if none is valid though there are rows."""
    good = checked.filter("valid")
    if good.isEmpty() and (bad := checked.limit(show).collect()):
        raise ValueError(f"no valid row: {[r['errors'] for r in bad]}")
    return good.drop("errors", "valid")


def priced(models: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """models (model_name) with per_k_in, per_k_out: the exact price key, else the first in price order that either begins or is begun by the name."""
    fits = models.select("model_name").distinct().join(F.broadcast(prices), F.expr("startswith(model_name, price_key) OR startswith(price_key, model_name)"))  # price lists are small by nature
    first = F.row_number().over(Window.partitionBy("model_name").orderBy(F.col("model_name") != F.col("price_key"), "ord"))
    best = fits.withColumn("_nth", first).filter("_nth = 1").select("model_name", "price_key", "per_k_in", "per_k_out")
    out = models.join(best, "model_name", "left")
    return out.withColumns({"per_k_in": F.coalesce("per_k_in", F.lit(default[0])), "per_k_out": F.coalesce("per_k_out", F.lit(default[1]))})


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do when a run is resumed."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def pages_until_stop(cards: DataFrame, key: Column) -> DataFrame:
    """Cards (category, page, pos) of the pages before the first that brings nothing new in its category."""
    from brasstack.operators.dedup import keep_first

    fresh = keep_first(cards.withColumn("_key", key), F.struct("category", "_key"), ["page", "pos"]).drop("_key")
    new = fresh.groupBy("category", "page").agg(F.count(F.lit(1)).alias("_new"))
    idle = cards.select("category", "page").distinct().join(new, ["category", "page"], "left_anti")
    stop = idle.groupBy("category").agg(F.min("page").alias("_stop"))
    return fresh.join(stop, "category", "left").filter("_stop IS NULL OR page < _stop").drop("_stop")


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def chosen(sources: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """The union of the sources that are named (all where none are), columns by name. One that failed (see attempted)
    is left out."""
    parts = [df for k, df in sources.items() if (not names or k in names) and df is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def attempted(make: dict) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Sources by name from functions that make them, and the errors of those that failed."""
    good, bad = {}, {}
    for name, f in make.items():
        try:
            good[name] = f()
            good[name].limit(1).count()
        except Exception as e:  # noqa: BLE001 - one source's failure must not end the others
            good.pop(name, None)
            bad[name] = str(e)[:500]
    return good, bad


def split_observed(df: DataFrame, rules: dict[str, Column], at: str, by: str = "valid") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, rejected rows with their errors, counts), from one job: rows are checked and written below `at` once, split by
    validity, and their counts are observed on the way: rows, rejected, and each rule's breaks.

    Raises if there are rows and none is valid; what was written then stays for inspection. Column `by` must not be one of df's.
    """
    seen = Observation()
    broken = [F.count_if(F.array_contains("errors", name)).alias(f"broken_{k}") for k, name in enumerate(rules)]
    checked = validate(df, rules).withColumnRenamed("valid", by)
    checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(by)).alias("rejected"), *broken).write.partitionBy(by).parquet(at)
    got = seen.get
    counts = {"rows": got["rows"], "rejected": got["rejected"]} | {name: got[f"broken_{k}"] for k, name in enumerate(rules)}
    if counts["rows"] and counts["rows"] == counts["rejected"]:
        raise ValueError(f"no valid row: {counts}")
    back = df.sparkSession.read.schema(checked.schema).parquet(at)
    return back.filter(F.col(by)).drop("errors", by), back.filter(~F.col(by)).drop(by), counts

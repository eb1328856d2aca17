"""Accuracy, agreement, failure modes, tiers and costs; each works for all models at once, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstack.functions.text import budget_tier, triggered


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def correct(selected: str = "selected_option", truth: str = "truth") -> Column:
    """1 or 0; an answer that couldn't be read is wrong, not missing."""
    return F.when(F.coalesce(F.upper(F.col(selected)) == F.upper(F.col(truth)), F.lit(False)), 1.0).otherwise(0.0)


def mcq_accuracy(completions: DataFrame, truths: DataFrame, by: list[str]) -> DataFrame:
    met = completions.join(truths, "problem_id")
    return met.groupBy(*by).agg(zero_if_null(F.avg(correct())).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def average_score(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(zero_if_null(F.avg("total_score")).alias("average"), F.count(F.lit(1)).alias("n"))


def cohens_kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Unweighted agreement of two label columns; null where one label is all there is."""
    by = by or []
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("k")).select(*by, F.col(a).alias("x"), F.col(b).alias("y"), "k")
    sides = cells.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("x").alias("v"), "k"), F.struct(F.lit(1).alias("s"), F.col("y").alias("v"), "k"))).alias("e"))
    margin = sides.groupBy(*by, "e.v").agg(F.sum(F.when(F.col("e.s") == 0, F.col("e.k")).otherwise(0)).alias("p"), F.sum(F.when(F.col("e.s") == 1, F.col("e.k")).otherwise(0)).alias("q"))
    chance = margin.groupBy(*by).agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
    total = cells.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("k")).otherwise(0)).alias("same"))
    met = total.join(chance, by) if by else total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("pq") / (F.col("n") * F.col("n"))
    return met.select(*by, F.col("n"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def failure_mode(total: Column, adherence: Column, viability: Column, failed: Column) -> Column:
    """In order: none at 3, abandonment at 0, constraint, hallucination, else constraint."""
    return (F.when(total == 3, F.lit(None).cast("string")).when(total == 0, "task_abandonment").when(failed | (adherence == 0), "constraint_violation")
            .when(viability == 0, "physical_hallucination").otherwise("constraint_violation"))


def failure_modes(rows: DataFrame, by: list[str]) -> DataFrame:
    mode = failure_mode(F.col("total_score"), F.col("constraint_adherence"), F.col("physical_viability"), F.coalesce(F.col("auto_fail"), F.lit(False)))
    modes = ("constraint_violation", "physical_hallucination", "task_abandonment")
    return rows.withColumn("mode", mode).groupBy(*by).agg(*(F.count_if(F.col("mode") == m).alias(m + "s") for m in modes), F.count("mode").alias("total"))


def total_score(*parts: str) -> Column:
    return sum((F.col(p) for p in parts[1:]), F.col(parts[0]))


def guard(completions: DataFrame, problems: DataFrame) -> DataFrame:
    """completions with triggered_keywords and filter_result."""
    met = completions.join(problems.select("problem_id", "forbidden"), "problem_id")
    met = met.withColumn("triggered_keywords", triggered(F.col("raw_output"), F.col("forbidden")))
    return met.withColumn("filter_result", F.when(F.size("triggered_keywords") > 0, "auto_fail").otherwise("clean"))


def two_stage(guarded: DataFrame, scores: DataFrame) -> DataFrame:
    """Judge scores by key for clean rows; guarded failures get zeros and a reason."""
    met = guarded.join(scores, "problem_id", "left")
    failed = F.col("filter_result") == "auto_fail"
    parts = ("constraint_adherence", "inventory_utilization", "physical_viability")
    out = met.withColumns({p: F.when(failed, 0).otherwise(F.col(p)) for p in parts})
    # fixed value: the reason's wording
    reason = F.concat(F.lit("AUTO_FAIL: forbidden keywords ['"), F.array_join("triggered_keywords", "', '"), F.lit("']"))
    return out.withColumns({"auto_fail": failed, "total_score": total_score(*parts), "reason": F.when(failed, reason)})


def token_cost(input_tokens: Column, output_tokens: Column, per_k_in: Column, per_k_out: Column) -> Column:
    return input_tokens / 1000 * per_k_in + output_tokens / 1000 * per_k_out


def evaluate(completions: DataFrame, problems: DataFrame, verified: DataFrame) -> DataFrame:
    """One row per model: accuracy, mean score, failure counts, flat-rate cost, numbers of rows; models without scores stay."""
    mcq = mcq_accuracy(completions, problems.select("problem_id", "truth"), ["model_name"]).select("model_name", F.col("accuracy").alias("mcq_accuracy"))
    flat = completions.groupBy("model_name").agg(F.sum(token_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(0.001), F.lit(0.002))).alias("cost_usd"), F.count(F.lit(1)).alias("n_completions"))
    judged = verified.filter("total_score IS NOT NULL")
    avg = average_score(judged, ["model_name"]).select("model_name", F.col("average").alias("open_gen_average"), F.col("n").alias("n_judged"))
    modes = failure_modes(judged, ["model_name"]).drop("total")
    return (flat.join(mcq, "model_name", "left").join(avg, "model_name", "left").join(modes, "model_name", "left")
            .na.fill(0.0, ["mcq_accuracy", "open_gen_average"]).na.fill(0, ["n_judged", "constraint_violations", "physical_hallucinations", "task_abandonments"]))


def nested_result(completions: DataFrame, problems: DataFrame, verified: DataFrame) -> DataFrame:
    """evaluate() with maps: domain to its accuracy and average (domains without rows have 0), budget label to its average."""
    models = completions.select("model_name").distinct()
    grid = models.join(F.broadcast(problems.select("domain").distinct()), how="cross")  # a handful of either
    mcq = mcq_accuracy(completions, problems.select("problem_id", "domain", "truth"), ["model_name", "domain"]).select("model_name", "domain", F.col("accuracy").alias("mcq"))
    judged = verified.filter("total_score IS NOT NULL").join(problems.select("problem_id", "domain", "budget"), "problem_id")
    og = average_score(judged, ["model_name", "domain"]).select("model_name", "domain", F.col("average").alias("open_gen"))
    cells = grid.join(mcq, ["model_name", "domain"], "left").join(og, ["model_name", "domain"], "left").na.fill(0.0, ["mcq", "open_gen"])
    pairs = lambda *c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(*c))))
    domains = cells.groupBy("model_name").agg(pairs("domain", F.struct("mcq", "open_gen")).alias("domain_performance"))
    label = F.concat(F.lit("₹"), budget_tier(F.col("budget")).cast("string"))
    tiers = judged.groupBy("model_name", label.alias("label")).agg(F.avg("total_score").alias("average")).groupBy("model_name").agg(pairs("label", "average").alias("budget_tier_performance"))
    return evaluate(completions, problems, verified).join(domains, "model_name", "left").join(tiers, "model_name", "left")


def dry_run(prompts: DataFrame, models: DataFrame, out_tokens: tuple[int, int] = (50, 300)) -> DataFrame:
    """A row per model, and one of model_name null for all: prompts have mcq_tokens and opengen_tokens, models model_name,
    per_k_in, per_k_out; each problem is taken to be answered with out_tokens. Costs are rounded to 4 digits, the grand total
    is that of rounded ones."""
    total = prompts.agg(F.count(F.lit(1)).alias("n_problems"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("mcq_tokens", "opengen_tokens")])  # one row
    both = models.join(F.broadcast(total), how="cross")
    cost = lambda c, n: token_cost(F.col(c), n * F.col("n_problems"), F.col("per_k_in"), F.col("per_k_out"))
    mcq, og = cost("mcq_tokens", out_tokens[0]), cost("opengen_tokens", out_tokens[1])
    each = both.select("model_name", "n_problems", "mcq_tokens", "opengen_tokens", F.round(mcq, 4).alias("mcq_cost"), F.round(og, 4).alias("opengen_cost"), F.round(mcq + og, 4).alias("total_cost"))
    grand = each.agg(F.max("n_problems").alias("n_problems"), F.round(F.sum("total_cost"), 4).alias("total_cost"))
    return each.unionByName(grand, allowMissingColumns=True)

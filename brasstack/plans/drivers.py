"""Whole runs: seeds from raw cases, the mutation matrix, formatted problems, completions, judging and results.

Model calls go through a completer (see completer.py) that turns (key, prompt) into (key, raw_output, error); answers are
JSON. A call that fails, or an answer that doesn't fit, costs its row and is counted, never the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstack.functions import prompts as P
from brasstack.functions.text import option_letter
from brasstack.operators import dedup, metrics, models, sample, select
from brasstack.scratch import cut

# What models answer with, as JSON.
SEED = "seed_id string, domain string, target_goal string, core_physics_mechanism string, historical_materials_used array<string>, source_reference string"
INVENTORY = "adjusted_inventory array<string>, context_narrative string, reasoning string"
FORMATTED = (
    "prompt_context string, correct_option string, distractors struct<abundance_distractor: string, brute_force_distractor: string, wrong_mechanism_distractor: string>, "
    "essential_keywords array<string>, forbidden_keywords array<string>, required_physical_mechanism string"
)
SCORE = "reasoning string, constraint_adherence int, inventory_utilization int, physical_viability int, total_score int"
RAW_CASE = "source string, url_or_path string, raw_text string, title string, innovator_name string, location string, category string"


def asked(rows: DataFrame, key: str, prompt, completer, schema: str | None = None) -> DataFrame:
    """rows with raw_output and error, and answer where a schema is given: null if the call failed or the answer doesn't parse."""
    own = cut(rows.withColumn("_prompt", prompt), "prompts")
    got = completer.complete(own.select(F.col(key).cast("string").alias("key"), F.col("_prompt").alias("prompt"))).select("key", "raw_output", "error")
    met = own.drop("_prompt").join(cut(got, "answers"), own[key].cast("string") == F.col("key"), "left").drop("key")
    return met.withColumn("answer", F.from_json("raw_output", schema)) if schema else met


def generated_cases(completer, request: str, source: str, spark) -> DataFrame:
    """Raw cases of one call that answers with an array of them; invalid ones go."""
    got = asked(spark.createDataFrame([("cases", request)], "id string, request string"), "id", F.col("request"), completer)
    rows = got.select(F.explode(F.from_json("raw_output", f"array<struct<{RAW_CASE}>>")).alias("c")).select("c.*").withColumn("source", F.coalesce("source", F.lit(source)))
    return select.validate(rows, models.raw_case_rules()).filter("valid").drop("errors", "valid")


def extract_seeds(cases: DataFrame, completer, quotas: dict[str, int], target: int) -> DataFrame:
    """Seeds from raw cases (ord and the case's columns): asked for, checked, freed of near copies in order, chosen by quota
    and numbered."""
    got = asked(cases, "ord", P.extraction_prompt(), completer, SEED)
    # extracted() looks at the answer's columns and at the case's source
    rows = models.extracted(got.filter("answer IS NOT NULL").select("ord", "source", "url_or_path", "answer.*"))
    own = cut(rows.drop("source", "url_or_path"), "seeds")
    kept = dedup.fuzzy_dedup(own.select(F.col("ord").cast("long").alias("ord"), F.col("target_goal").alias("text"))).select("ord")
    best = select.quota(own.join(kept, "ord", "left_semi"), quotas, list(models.DOMAINS), target)
    return best.withColumn("seed_id", select.seed_id(F.col("place"))).drop("ord").withColumnRenamed("place", "position")


def finalise_seeds(reviewed: DataFrame, order: str = "ord") -> DataFrame:
    """Reviewed seeds: any id is replaced, invalid rows go (all invalid raises), the rest are numbered in order."""
    good = models.valid_seeds(reviewed.withColumn("seed_id", F.lit(models.PLACEHOLDER)))
    return select.number(good, [order]).withColumn("seed_id", select.seed_id(F.col("position")))


def mutation_plan(seeds: DataFrame, space: DataFrame, count: int = 10) -> DataFrame:
    """Every seed with `count` constraint profiles and the ids of the instances they will be."""
    picks = sample.stratified_exact(seeds, models.require_space(space), count)
    return picks.join(seeds, "seed_id").withColumn("instance_id", select.instance_id(F.col("seed_id"), F.col("k")))


def mutate(seeds: DataFrame, space: DataFrame, completer, count: int = 10) -> tuple[DataFrame, DataFrame]:
    """Valid mutated instances, and the instance_id, error and errors of those that failed."""
    plan = mutation_plan(seeds, space, count)
    got = asked(plan, "instance_id", P.mutation_prompt(), completer, INVENTORY)
    rows = got.select(
        "instance_id", "seed_id", "domain", "target_goal", "core_physics_mechanism", F.struct("budget", "environment", "infrastructure").alias("applied_constraints"),
        "answer.adjusted_inventory", "answer.context_narrative", F.col("historical_materials_used").alias("original_materials"), "error")
    return _split(cut(select.validate(rows, models.instance_rules()), "instances"), "instance_id")


def _split(checked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return checked.filter("valid").drop("errors", "valid", "error"), checked.filter("not valid").select(key, "error", "errors")


def format_problems(instances: DataFrame, completer, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """Valid problems, and problem_id, error and errors of instances of which no try gave one.

    The order of a problem's options follows its id alone, whichever try succeeds. A try asks again for what failed, under
    the key `instance_id`#try, from the second try on.
    """
    left, good, bad = instances, None, None
    for k in range(1, tries + 1):
        keyed = left.withColumn("_key", F.col("instance_id") if k == 1 else F.concat("instance_id", F.lit(f"#{k}")))
        got = asked(keyed, "_key", P.formatting_prompt(), completer, FORMATTED).withColumn("problem_id", select.problem_id(F.col("instance_id")))
        d = F.col("answer.distractors")
        order = F.array("answer.correct_option", d["abundance_distractor"], d["brute_force_distractor"], d["wrong_mechanism_distractor"])
        shuffled = sample.shuffle_options(got.filter("answer IS NOT NULL").select("problem_id", order.alias("options")))
        shuffled = shuffled.select("problem_id", F.struct("A", "B", "C", "D").alias("mcq_options"), F.col("answer").alias("ground_truth_option"))
        rubric = F.struct("answer.essential_keywords", "answer.forbidden_keywords", "answer.required_physical_mechanism")
        rows = got.join(shuffled, "problem_id", "left").select(
            "problem_id", "instance_id", "domain", F.struct(F.col("seed_id").alias("seed_source"), F.col("core_physics_mechanism").alias("physics_principle")).alias("metadata"), "answer.prompt_context",
            "applied_constraints", F.col("adjusted_inventory").alias("available_inventory"), "mcq_options", "ground_truth_option", rubric.alias("ground_truth_synthesis_rubric"), "error")
        checked = cut(select.validate(rows, models.problem_rules()), "problems")
        now, bad = _split(checked, "instance_id")
        now = now.drop("instance_id")
        good = now if good is None else good.unionByName(now)
        if bad.isEmpty():
            break
        left = left.join(bad.select("instance_id"), "instance_id", "left_semi")
    return good, bad


MODES = {"mcq": lambda: P.mcq_prompt(F.col("prompt_context"), F.col("applied_constraints"), F.col("available_inventory"), F.col("mcq_options")),
         "opengen": lambda: P.opengen_prompt(F.col("prompt_context"), F.col("applied_constraints"), F.col("available_inventory"))}


def run_benchmark(problems: DataFrame, names: DataFrame, mode: str, completer, done: DataFrame | None = None, counter=None) -> tuple[DataFrame, DataFrame]:
    """Completions of every model (names: model_name) on every problem that isn't in done (model_name, mode, problem_id),
    and the keys and errors of calls that failed. Keys of calls are model/mode/problem."""
    todo = problems.join(F.broadcast(names.select("model_name").distinct()), how="cross").withColumn("mode", F.lit(mode))  # a handful of models
    if done is not None:
        todo = select.remaining(todo, done, ["model_name", "mode", "problem_id"])
    todo = todo.withColumns({"call": F.concat_ws("/", "model_name", "mode", "problem_id"), "prompt_sent": MODES[mode]()})
    got = cut(asked(todo.select("call", "model_name", "mode", "problem_id", "prompt_sent"), "call", F.col("prompt_sent"), completer), "completions")
    good = got.filter("raw_output IS NOT NULL").select(
        "problem_id", "model_name", "mode", "prompt_sent", "raw_output", (option_letter(F.col("raw_output")) if mode == "mcq" else F.lit(None).cast("string")).alias("selected_option"),
        P.token_count(F.col("prompt_sent"), counter).cast("int").alias("input_tokens"), P.token_count(F.col("raw_output"), counter).cast("int").alias("output_tokens"))
    return good, got.filter("raw_output IS NULL").select("model_name", "mode", "problem_id", "error")


def judge(completions: DataFrame, problems: DataFrame, completer) -> DataFrame:
    """Scores of completions (model_name, problem_id, raw_output) by key; raises if any row has none, as a partial result
    would pass for a whole one. Repeated completions of one model and problem share a score."""
    own = completions.dropDuplicates(["model_name", "problem_id"]).join(problems, "problem_id").withColumn("call", F.concat_ws("/", "model_name", "problem_id"))
    prompt = P.judge_prompt(F.col("prompt_context"), F.col("applied_constraints"), F.col("available_inventory"), F.col("ground_truth_synthesis_rubric"), F.col("raw_output"))
    own = own.withColumn("prompt", prompt).withColumnRenamed("raw_output", "model_output")
    got = asked(own.select("call", "model_name", "problem_id", "model_output", "prompt"), "call", F.col("prompt"), completer, SCORE)
    good = cut(models.scored(got.select("model_name", "problem_id", "model_output", "prompt", "answer.*")), "scores")
    if (n := own.count()) != (m := good.count()):
        raise ValueError(f"{n - m} of {n} completions have no valid score")
    return good


def verify(completions: DataFrame, problems: DataFrame, completer) -> DataFrame:
    """Two stages: the keyword guard, then the judge on what passes; guarded failures get zeros and a reason."""
    listed = problems.select("problem_id", F.col("ground_truth_synthesis_rubric.forbidden_keywords").alias("forbidden"))
    guarded = cut(metrics.guard(completions, listed), "guarded")
    scores = judge(guarded.filter("filter_result = 'clean'").select("model_name", "problem_id", "raw_output"), problems, completer)
    keyed = guarded.withColumn("problem_id", F.struct("model_name", "problem_id"))
    out = metrics.two_stage(keyed, scores.select(F.struct("model_name", "problem_id").alias("problem_id"), *models.SCORES))
    return out.withColumn("problem_id", F.col("problem_id.problem_id"))


def results(mcq: DataFrame, verified: DataFrame, problems: DataFrame, judged_only: bool = False) -> DataFrame:
    """One nested result a model; judged_only restricts answers to problems that the model was judged on."""
    flat = problems.select("problem_id", "domain", F.col("applied_constraints.budget").alias("budget"), F.col("ground_truth_option").alias("truth"))
    if judged_only:
        mcq = mcq.join(verified.filter("total_score IS NOT NULL").select("model_name", "problem_id").distinct(), ["model_name", "problem_id"], "left_semi")
    return metrics.nested_result(mcq, flat, verified)


def calibration(human: DataFrame, judged: DataFrame, least: int = 10, threshold: float = 0.8) -> DataFrame:
    """Kappa a model of human and judge totals (problem_id, score) met by key; models with under `least` common problems are left out."""
    met = human.select("problem_id", F.col("score").alias("human")).join(judged.select("model_name", "problem_id", F.col("total_score").alias("judge")), "problem_id")
    k = metrics.cohens_kappa(met, "human", "judge", ["model_name"]).filter(F.col("n") >= least)
    return k.withColumn("valid", F.coalesce(F.col("kappa") >= threshold, F.lit(False)))


def plot_frames(result: DataFrame) -> dict[str, DataFrame]:
    """The three frames that figures are drawn from, of results(): by format, by budget tier, by failure mode."""
    formats = result.select("model_name", F.expr("stack(2, 'mcq', 100 * mcq_accuracy, 'opengen', open_gen_average / 3 * 100) AS (format, pct)"))
    tiers = result.select("model_name", F.explode("budget_tier_performance").alias("label", "average"))
    place = F.when(F.col("label") == "₹200", 0).when(F.col("label") == "₹50", 1).when(F.col("label") == "₹0", 2)
    modes = ("constraint_violations", "physical_hallucinations", "task_abandonments")
    total = result.agg(*[F.sum(m).alias(m) for m in modes])  # one row
    shares = total.select(*[F.coalesce(F.try_divide(m, sum((F.col(x) for x in modes[1:]), F.col(modes[0]))), F.lit(0.0)).alias(m) for m in modes])
    domains = result.select(F.explode(F.map_keys("domain_performance")).alias("domain")).distinct()
    return {"discriminative": formats, "scarcity": tiers.withColumn("place", place).filter("place IS NOT NULL"), "failures": domains.join(F.broadcast(shares), how="cross")}

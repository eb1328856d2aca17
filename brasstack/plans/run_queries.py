"""Queries of whole runs (drivers.py): recorded answers are derived from the given tables, failures and retries among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstack.operators import sample, select
from brasstack.plans import drivers
from brasstack.plans.completer import Replay
from brasstack.plans.fixtures import DOMAINS, pick, read, view
from brasstack.plans.queries import query

MODELS = ("m0", "m1")
PICKS = 10
_MARKS = " UNION ALL ".join(f"SELECT {k} AS k, '{m}' AS model_name" for k, m in enumerate(MODELS))


def posed(spark, sf):
    """A problem of each document: its text is the context."""
    return view(spark, sf, "problems").select(
        F.col("problem_id").alias("id"), F.col("problem_id").cast("string").alias("problem_id"), F.col("text").alias("prompt_context"), F.struct("budget", "environment", "infrastructure").alias("applied_constraints"),
        F.array("lang", "source").alias("available_inventory"), F.struct(*[F.concat(F.lit(f"option {x} of "), "domain").alias(x) for x in "ABCD"]).alias("mcq_options"),
        F.struct(F.array("lang").alias("essential_keywords"), F.array("source").alias("forbidden_keywords"), F.lit("lever and pulley").alias("required_physical_mechanism")).alias("ground_truth_synthesis_rubric"))


@query(f"""SELECT model_name, CAST(doc_id AS varchar) AS problem_id, CASE WHEN (doc_id + k) % 7 <> 3 AND doc_id % 11 <> 5 THEN substr('ABCD', CAST((doc_id + k) % 4 + 1 AS int), 1) END AS selected_option,
  CASE WHEN (doc_id + k) % 7 = 3 THEN 'no recorded output' END AS error FROM {{documents}}, ({_MARKS}) WHERE NOT (model_name = 'm1' AND doc_id % 13 = 0)""")
def run_benchmark_resumed(spark, sf):
    problems = posed(spark, sf)
    ids = problems.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("model_name")) for k, m in enumerate(MODELS)])).alias("m")).select("id", "m.*")
    letter = F.substring(F.lit("ABCD"), ((F.col("id") + F.col("k")) % 4 + 1).cast("int"), F.lit(1))
    said = F.when(F.col("id") % 11 == 5, "I can't tell").otherwise(F.concat(F.lit("The answer is "), letter))
    recorded = ids.filter("(id + k) % 7 <> 3").select(F.concat_ws("/", "model_name", F.lit("mcq"), F.col("id").cast("string")).alias("key"), said.alias("raw_output"))
    done = ids.filter("k = 1 AND id % 13 = 0").select("model_name", F.lit("mcq").alias("mode"), F.col("id").cast("string").alias("problem_id"))
    good, lost = drivers.run_benchmark(problems.drop("id"), spark.createDataFrame([(m,) for m in MODELS], "model_name string"), "mcq", Replay(recorded), done)
    columns = "model_name", "problem_id", "selected_option", "error"
    return good.withColumn("error", F.lit(None).cast("string")).select(*columns).unionByName(lost.withColumn("selected_option", F.lit(None).cast("string")).select(*columns))


@query("""SELECT 'm0' AS model_name, CAST(problem_id AS varchar) AS problem_id, constraint_adherence, inventory_utilization, physical_viability,
  constraint_adherence + inventory_utilization + physical_viability AS total_score FROM {scores}""")
def judge_replayed(spark, sf):
    scores = view(spark, sf, "scores")
    answer = F.to_json(F.struct(F.lit("seen").alias("reasoning"), "constraint_adherence", "inventory_utilization", "physical_viability", F.lit(9).alias("total_score")))
    recorded = scores.select(F.concat(F.lit("m0/"), F.col("problem_id").cast("string")).alias("key"), answer.alias("raw_output"))
    completions = scores.select(F.lit("m0").alias("model_name"), F.col("problem_id").cast("string").alias("problem_id"), F.concat(F.lit("do "), F.col("problem_id").cast("string")).alias("raw_output"))
    return drivers.judge(completions, posed(spark, sf).drop("id"), Replay(recorded)).select("model_name", "problem_id", *(k for k in ("constraint_adherence", "inventory_utilization", "physical_viability")), "total_score")


def seeded(spark, sf):
    """A seed of each benchmark item."""
    return read(spark, sf, "benchmark").select(
        "item_id", select.seed_id(F.col("item_id") + 1).alias("seed_id"), F.expr(pick("item_id", *DOMAINS)).alias("domain"), F.rpad("text", 20, ".").alias("target_goal"),
        F.lit("lever and pulley").alias("core_physics_mechanism"), F.array(F.lit("rope"), F.lit("tin")).alias("historical_materials_used"))


@query(f"""WITH i AS (SELECT format('MI_{{:03d}}_{{:02d}}', item_id + 1, k) AS instance_id, (item_id + k) % 9 AS w FROM {{benchmark}}, range(1, {PICKS + 1}) r(k))
  SELECT instance_id, w > 2 AS valid, CASE WHEN w > 2 THEN 2 END AS materials, CASE WHEN w = 0 THEN 'no recorded output' END AS error,
  CASE WHEN w IN (0, 1) THEN 'adjusted_inventory,context_narrative' WHEN w = 2 THEN 'adjusted_inventory' END AS errors FROM i""")
def mutate_replayed(spark, sf):
    seeds = seeded(spark, sf)
    inventory = F.when(F.col("w") == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("rope"), F.lit("tin")))
    answer = F.to_json(F.struct(inventory.alias("adjusted_inventory"), F.lit("Asha stands in a village near the river.").alias("context_narrative"), F.lit("r").alias("reasoning")))
    calls = seeds.select("item_id", "seed_id", F.explode(F.sequence(F.lit(1), F.lit(PICKS))).alias("k")).withColumn("w", (F.col("item_id") + F.col("k")) % 9)
    recorded = calls.filter("w <> 0").select(select.instance_id(F.col("seed_id"), F.col("k")).alias("key"), F.when(F.col("w") == 1, "no JSON").otherwise(answer).alias("raw_output"))
    good, bad = drivers.mutate(seeds.drop("item_id"), sample.constraint_space(spark), Replay(recorded), PICKS)
    none = F.lit(None).cast("string")
    good = good.select("instance_id", F.lit(True).alias("valid"), F.size("adjusted_inventory").alias("materials"), none.alias("error"), none.alias("errors"))
    return good.unionByName(bad.select("instance_id", F.lit(False).alias("valid"), F.lit(None).cast("int").alias("materials"), "error", F.array_join(F.array_sort("errors"), ",").alias("errors")))


@query("""WITH i AS (SELECT item_id, k, (item_id + k) % 6 AS w FROM {benchmark}, range(1, 3) r(k))
  SELECT format('JR-1K-{:03d}-{:02d}', item_id + 1, k) AS problem_id, w <> 1 AS valid, CASE WHEN w = 1 THEN NULL WHEN w = 0 THEN 2 WHEN w = 2 THEN 3 ELSE 1 END AS try FROM i""")
def format_replayed(spark, sf):
    """A first call without an answer and a malformed one are asked for again; a context that stays too short never gives a problem."""
    seeds = seeded(spark, sf)
    instances = seeds.select(
        "item_id", "seed_id", "domain", "target_goal", "core_physics_mechanism", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k"), F.lit("Asha stands in a village near the river.").alias("context_narrative"),
        F.struct(F.lit("₹0").alias("budget"), F.lit("hot").alias("environment"), F.lit("no power").alias("infrastructure")).alias("applied_constraints"),
        F.array(F.lit("rope"), F.lit("tin")).alias("adjusted_inventory"), F.col("historical_materials_used").alias("original_materials")).withColumn("instance_id", select.instance_id(F.col("seed_id"), F.col("k")))
    context = F.when(F.col("w") == 1, "short").otherwise(F.concat(F.lit("Asha has rope and tin and must lift water by noon today, try "), F.col("try").cast("string")))
    wrong = F.struct(*[F.lit(t).alias(k) for k, t in (("abundance_distractor", "buy it all online"), ("brute_force_distractor", "carry it all by hand"), ("wrong_mechanism_distractor", "use rope as a pipe"))])
    answer = F.to_json(F.struct(context.alias("prompt_context"), F.lit("the right way to do it").alias("correct_option"), wrong.alias("distractors"), F.array(F.lit("rope")).alias("essential_keywords"),
                                F.array(F.lit("motor")).alias("forbidden_keywords"), F.lit("lever and pulley").alias("required_physical_mechanism")))
    calls = instances.select("instance_id", ((F.col("item_id") + F.col("k")) % 6).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("try"))
    calls = calls.filter("NOT (w = 0 AND try = 1) AND NOT (w = 2 AND try = 2)")
    key = F.when(F.col("try") == 1, F.col("instance_id")).otherwise(F.concat("instance_id", F.lit("#"), F.col("try").cast("string")))
    recorded = calls.select(key.alias("key"), F.when((F.col("w") == 2) & (F.col("try") == 1), "{").otherwise(answer).alias("raw_output"))
    good, bad = drivers.format_problems(instances.drop("item_id", "k"), Replay(recorded))
    tried = F.regexp_extract("prompt_context", "try ([0-9])$", 1).cast("int")
    return good.select("problem_id", F.lit(True).alias("valid"), tried.alias("try")).unionByName(bad.select(select.problem_id(F.col("instance_id")).alias("problem_id"), F.lit(False).alias("valid"), F.lit(None).cast("int").alias("try")))

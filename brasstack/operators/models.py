"""Rules of the benchmark's entities: name to condition, for select.validate; a null condition counts as broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstack.operators.select import require_some, validate

# The domains, answer letters and least lengths of the entities.
DOMAINS = ("agriculture", "healthcare", "construction", "street_vending")
LETTERS = ("A", "B", "C", "D")
SCORES = ("constraint_adherence", "inventory_utilization", "physical_viability")
PLACEHOLDER = "SEED_000"
SPACE_SIZE = 27


def stripped(c: Column) -> Column:
    """Without white space at either end, as Unicode counts it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def long(c, n: int) -> Column:
    return F.length(c) >= n


def seed_rules() -> dict[str, Column]:
    return {
        "seed_id": F.col("seed_id").rlike(r"^SEED_\d{3}$"), "domain": F.col("domain").isin(*DOMAINS), "target_goal": long("target_goal", 20),
        "core_physics_mechanism": long("core_physics_mechanism", 10), "source_reference": long("source_reference", 5),
        "historical_materials_used": (F.size("historical_materials_used") >= 1) & F.forall("historical_materials_used", lambda m: long(stripped(m), 3)),
    }


def raw_case_rules() -> dict[str, Column]:
    return {"source": F.col("source").isNotNull(), "url_or_path": F.col("url_or_path").isNotNull(), "raw_text": long("raw_text", 20)}


def instance_rules() -> dict[str, Column]:
    given = ("seed_id", "target_goal", "core_physics_mechanism", "applied_constraints", "original_materials")
    return {"instance_id": F.col("instance_id").rlike(r"^MI_\d{3}_\d{2}$"), "domain": F.col("domain").isin(*DOMAINS), "adjusted_inventory": F.size("adjusted_inventory") >= 1,
            "context_narrative": long("context_narrative", 20)} | {k: F.col(k).isNotNull() for k in given}


def problem_rules() -> dict[str, Column]:
    rubric, options = F.col("ground_truth_synthesis_rubric"), F.col("mcq_options")
    return {
        "problem_id": F.col("problem_id").rlike(r"^JR-1K-\d{3}-\d{2}$"), "domain": F.col("domain").isin(*DOMAINS), "prompt_context": long("prompt_context", 50),
        "mcq_options": F.lit(True) & long(options["A"], 10) & long(options["B"], 10) & long(options["C"], 10) & long(options["D"], 10),
        "ground_truth_option": F.col("ground_truth_option").isin(*LETTERS), "essential_keywords": F.size(rubric["essential_keywords"]) >= 1,
        "forbidden_keywords": F.size(rubric["forbidden_keywords"]) >= 1, "required_physical_mechanism": long(rubric["required_physical_mechanism"], 10),
    }


def score_rules() -> dict[str, Column]:
    """Of a judge's scores before the total is rewritten."""
    return {k: F.col(k).isin(0, 1) for k in SCORES} | {"reasoning": F.col("reasoning").isNotNull()}


def result_rules() -> dict[str, Column]:
    """Of one model's result: shares from 0 to 1, averages from 0 to 3, counters not below 0."""
    modes = F.col("failure_modes")
    return {
        "mcq_global_accuracy": F.col("mcq_global_accuracy").between(0, 1), "open_gen_global_average_score": F.col("open_gen_global_average_score").between(0, 3),
        "domain_performance": F.forall(F.map_values("domain_performance"), lambda d: d["mcq"].between(0, 1) & d["open_gen"].between(0, 3)),
        "failure_modes": (modes["constraint_violations"] >= 0) & (modes["physical_hallucinations"] >= 0) & (modes["task_abandonment"] >= 0),
    }


def with_stripped_materials(seeds: DataFrame, column: str = "historical_materials_used") -> DataFrame:
    return seeds.withColumn(column, F.transform(column, stripped))


def valid_seeds(rows: DataFrame) -> DataFrame:
    """The rows that hold, with materials stripped; raises only if none does though there are rows."""
    return with_stripped_materials(require_some(validate(rows, seed_rules())))


def scored(rows: DataFrame) -> DataFrame:
    """Valid judge scores with total_score as the sum of the parts, whatever total was given."""
    return validate(rows, score_rules()).filter("valid").drop("errors", "valid").withColumn("total_score", sum((F.col(k) for k in SCORES[1:]), F.col(SCORES[0])))


def extracted(answers: DataFrame) -> DataFrame:
    """Seeds from a model's answers (source, url_or_path and the seed's columns): goals of under 20 characters mean skip,
    unknown domains become the first, a blank reference names the source, the id is a placeholder; invalid rows go."""
    rows = answers.filter(long(stripped(F.col("target_goal")), 20))
    rows = rows.withColumns({
        "seed_id": F.lit(PLACEHOLDER), "domain": F.when(F.col("domain").isin(*DOMAINS), F.col("domain")).otherwise(DOMAINS[0]),
        "source_reference": F.coalesce(F.nullif("source_reference", F.lit("")), F.concat_ws(": ", "source", "url_or_path"))})
    return with_stripped_materials(validate(rows, seed_rules()).filter("valid").drop("errors", "valid"))


def require_space(space: DataFrame, size: int = SPACE_SIZE) -> DataFrame:
    """The constraint space, which must have `size` combinations."""
    if (n := space.count()) != size:
        raise ValueError(f"the constraint space has {n} combinations, not {size}")
    return space


def size_report(rows: DataFrame, expected: int) -> dict:
    """Found and expected rows; a difference is reported, not raised."""
    n = rows.count()
    return {"found": n, "expected": expected, "complete": n == expected}

"""Exports and append-only logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstack.functions.text import file_stem


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines by partition, for tables of any size."""
    df.write.mode("overwrite").json(path)


#: Most rows of a JSON array, which one task writes.
ARRAY_ROWS = 100_000


def export_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array in one file, in order, for exports that people read; raises over ARRAY_ROWS rows."""
    if (n := df.count()) > ARRAY_ROWS:
        raise ValueError(f"{n} rows are too many for one array; use export_json")
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    key = F.struct(*[f"_o{i}" for i in range(len(order))], "j")
    text = rows.agg(F.array_sort(F.collect_list(key)).alias("all")).select(F.concat(F.lit("[\n"), F.array_join(F.transform("all", lambda x: x["j"]), ",\n"), F.lit("\n]")).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def projections(problems: DataFrame) -> dict[str, DataFrame]:
    """What each audience gets: the whole, the questions without rubric, the open task without options and answer."""
    return {"full": problems, "mcq": problems.drop("ground_truth_synthesis_rubric"), "opengen": problems.drop("mcq_options", "ground_truth_option")}


def append_completions(df: DataFrame, path: str) -> None:
    """Appends rows of keys (model_name, mode, problem_id) that the log doesn't hold, once each: a second try adds nothing."""
    append_new(df.withColumn("model_file", file_stem(F.col("model_name"))), path, ["model_name", "mode", "problem_id"], ["model_file", "mode"])


def append_new(df: DataFrame, path: str, keys: list[str], by: list[str] | None = None) -> None:
    spark = df.sparkSession
    try:
        held = spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:  # no log yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    new = df if held is None else df.join(held, keys, "left_anti")
    new.dropDuplicates(keys).write.mode("append").partitionBy(*(by or [])).parquet(path)


def overwrite_scores(df: DataFrame, path: str) -> None:
    """One model's judge scores replace those it had; problem_id stays in each record. Other models' scores stay."""
    named = df.withColumn("model_file", file_stem(F.col("model_name")))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_file").parquet(path)


def excerpt(col: str, n: int = 500):
    return F.left(F.col(col), F.lit(n))


def audit_rows(judged: DataFrame, judge_model: str) -> DataFrame:
    """Audit records of judged rows (problem_id, model_output, prompt, the scores): excerpts of output and prompt."""
    return judged.select(F.current_timestamp().alias("timestamp"), F.lit(judge_model).alias("judge_model"), "problem_id", excerpt("model_output").alias("model_output_excerpt"),
                         excerpt("prompt").alias("user_prompt_excerpt"), F.struct("reasoning", "constraint_adherence", "inventory_utilization", "physical_viability", "total_score").alias("score"))


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

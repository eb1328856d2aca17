"""The benchmark's entities as views over the given tables, by text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CASE = "CASE {c} % {n} " + "{arms} END"


def pick(col: str, *options: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {col} % {len(options)} {arms} END"


DOMAINS = ("agriculture", "construction", "healthcare", "street_vending")
BUDGET = pick("d.doc_id", "₹0", "₹50", "₹200")
VIEWS = {
    "problems": f"""SELECT d.doc_id AS problem_id, {pick("d.doc_id", *DOMAINS)} AS domain, {BUDGET} AS budget,
        {pick("d.doc_id", "hot", "wet", "dusty", "cold", "dark")} AS environment, {pick("d.doc_id", "no power", "no tools", "no water", "no road", "no shade", "no roof", "no net")} AS infrastructure,
        {pick("d.doc_id", "A", "B", "C", "D")} AS truth, d.lang AS lang, d.source AS source, d.text AS text FROM documents d""",
    "completions": """SELECT conv_id AS problem_id, turn, concat('m', CAST(turn % 3 AS string)) AS model_name, text AS raw_output,
        CAST(length(text) AS bigint) AS input_tokens, CAST(length(text) % 97 AS bigint) AS output_tokens FROM conversations WHERE role = 'assistant'""",
    "scores": """SELECT doc_id AS problem_id, CAST(quality AS int) AS constraint_adherence, CAST(1 - toxic AS int) AS inventory_utilization,
        CAST(CASE WHEN doc_id % 5 < 3 THEN 1 ELSE 0 END AS int) AS physical_viability FROM labels""",
}
TABLES = ("documents", "labels", "benchmark", "conversations", "pages", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the given tables and VIEWS; {name} stands for a table or view."""
    frames = {n: read(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text}
    frames |= {n: view(spark, sf_dir, n) for n in VIEWS if "{" + n + "}" in text}
    return spark.sql(text, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for t in TABLES:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    return run(spark, sf_dir, text)


def oracle(text: str) -> str:
    """The same SQL for DuckDB, with the views as common table expressions."""
    used = [n for n in VIEWS if "{" + n + "}" in text]
    with_ = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    for n in (*VIEWS, *TABLES):
        text = text.replace("{" + n + "}", n)
    body = text.strip()
    if used:
        body = f"WITH {with_}" + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
    return body

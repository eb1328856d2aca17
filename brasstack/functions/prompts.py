"""Prompts as Catalyst expressions. System texts are the caller's; these are the texts that carry a row's values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What models are asked, with the names of a row's values in braces.
_CONSTRAINTS = "- Budget: {budget}\n- Environment: {environment}\n- Infrastructure: {infrastructure}\n"
MCQ = (
    "{prompt_context}\n\nConstraints:\n" + _CONSTRAINTS + "\nAvailable materials: {inventory}\n\n"
    "Options:\nA) {A}\nB) {B}\nC) {C}\nD) {D}\n\nChoose the best option (A, B, C, or D):"
)
OPENGEN = (
    "{prompt_context}\n\nConstraints:\n" + _CONSTRAINTS + "\nAvailable inventory:\n{items}\n\n"
    "Describe a solution using only the available materials. Explain the physical mechanism and how each material is used."
)
JUDGE = (
    "## Problem Context\n{prompt_context}\n\n## Constraints\n" + _CONSTRAINTS + "\n## Available Inventory\n{inventory}\n\n"
    "## Ground Truth Rubric\n- Essential keywords: {essential}\n- Forbidden keywords: {forbidden}\n- Required physical mechanism: {mechanism}\n\n"
    "## Model Output to Evaluate\n{output}\n\n"
    "Now evaluate the model output against the rubric. Provide your reasoning, then score each dimension."
)
EXTRACTION = (
    "Extract the structured innovation data from the following raw text.\n"
    "If this text does not describe a valid physical innovation with identifiable\n"
    "materials and mechanism, set target_goal to an empty string.\n\n"
    "Source: {source}\nPath/URL: {url_or_path}\n\n--- RAW TEXT ---\n{raw_text}\n--- END RAW TEXT ---\n\n"
    "Additional context (if available):\n- Title: {title}\n- Innovator: {innovator_name}\n- Location: {location}\n- Category: {category}\n"
)
MUTATION = (
    "Adjust the inventory for this innovation under the given constraints.\n\n"
    "SEED INNOVATION:\n- Target Goal: {target_goal}\n- Core Physics Mechanism: {core_physics_mechanism}\n- Domain: {domain}\n- Original Materials: {materials}\n\n"
    "APPLIED CONSTRAINTS:\n" + _CONSTRAINTS + "\nGenerate:\n1. adjusted_inventory: The modified materials list\n"
    "2. context_narrative: A 2-3 sentence scenario with character name, location, situation\n3. reasoning: Brief explanation of your material changes\n"
)
FORMATTING = (
    "Format this mutation instance into a benchmark problem:\n\n"
    "INSTANCE:\n- Instance ID: {instance_id}\n- Domain: {domain}\n- Target Goal: {target_goal}\n- Core Physics Mechanism: {core_physics_mechanism}\n\n"
    "CONSTRAINTS:\n" + _CONSTRAINTS + "\nAVAILABLE INVENTORY:\n{items}\n\nCONTEXT:\n{context_narrative}\n\n"
    "ORIGINAL MATERIALS (for reference, NOT available):\n{materials}\n\n"
    "Generate the prompt_context, correct_option, three distractors, and rubric.\n"
)
# Characters of a raw text that are shown, and what stands for a missing value.
RAW_CHARS, MISSING = 4000, "N/A"


def fill(template: str, **values: Column) -> Column:
    """The template with columns in place of the names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def sql_fill(template: str, **values: str) -> str:
    """fill() in SQL that Spark and DuckDB both read."""
    parts = re.split(r"\{(\w+)\}", template)
    quoted = ["'" + p.replace("'", "''") + "'" if not i % 2 else values[p] for i, p in enumerate(parts) if p]
    return " || ".join(quoted)


def listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")


def joined(items: Column) -> Column:
    return F.array_join(items, ", ")


def _limits(c: Column) -> dict[str, Column]:
    return {k: c[k] for k in ("budget", "environment", "infrastructure")}


def mcq_prompt(context: Column, constraints: Column, inventory: Column, options: Column) -> Column:
    return fill(MCQ, prompt_context=context, inventory=joined(inventory), **_limits(constraints), **{k: options[k] for k in "ABCD"})


def opengen_prompt(context: Column, constraints: Column, inventory: Column) -> Column:
    return fill(OPENGEN, prompt_context=context, items=listed(inventory), **_limits(constraints))


def judge_prompt(context: Column, constraints: Column, inventory: Column, rubric: Column, output: Column) -> Column:
    """What a judge is shown; rubric has essential_keywords, forbidden_keywords, required_physical_mechanism."""
    return fill(JUDGE, prompt_context=context, inventory=joined(inventory), essential=joined(rubric["essential_keywords"]), forbidden=joined(rubric["forbidden_keywords"]),
                mechanism=rubric["required_physical_mechanism"], output=output, **_limits(constraints))


def extraction_prompt() -> Column:
    """Of a raw case: its text cut, missing and empty values shown as such."""
    given = {k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(MISSING)) for k in ("title", "innovator_name", "location", "category")}
    return fill(EXTRACTION, source=F.col("source"), url_or_path=F.col("url_or_path"), raw_text=F.left("raw_text", F.lit(RAW_CHARS)), **given)


def mutation_prompt() -> Column:
    """Of a seed with one constraint profile."""
    own = {k: F.col(k) for k in ("target_goal", "core_physics_mechanism", "domain", "budget", "environment", "infrastructure")}
    return fill(MUTATION, materials=joined(F.col("historical_materials_used")), **own)


def formatting_prompt() -> Column:
    """Of a mutated instance."""
    own = {k: F.col(k) for k in ("instance_id", "domain", "target_goal", "core_physics_mechanism", "context_narrative")}
    return fill(FORMATTING, items=listed(F.col("adjusted_inventory")), materials=joined(F.col("original_materials")), **own, **_limits(F.col("applied_constraints")))


def token_count(text: Column, counter=None) -> Column:
    """Tokens of a text: by a vectorised counter (a Series of texts to a Series of numbers) where one is given, else a
    token for every four characters begun, which is an estimate and labelled so in the README."""
    if counter is None:
        return F.ceil(F.length(text) / 4).cast("long")
    return F.pandas_udf(counter, "long")(text)


def usage(reported: Column, text: Column, counter=None) -> Column:
    """The tokens that a provider reported, or where it reported none those counted here."""
    return F.coalesce(F.nullif(reported.cast("long"), F.lit(0)), token_count(text, counter))

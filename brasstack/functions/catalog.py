"""The scalar functions of text.py for SQL: functions with a SQL body in the session's catalog, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from brasstack.functions.text import OPTION_PATTERNS, stem_case

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+', 0)"
_STEMS = "transform(" + _TOKENS + ", w -> " + stem_case("w") + ")"
_BAG = "array_distinct(transform(array_distinct(" + _TOKENS.format("coalesce({0}, '')") + "), w -> " + stem_case("w") + "))"
_LETTERS = ", ".join(f"nullif(regexp_extract(body, r'(?i){p}', 1), '')" for p in OPTION_PATTERNS)

#: Name and parameters, type and body of each function.
FUNCTIONS = {
    "word_stem(word STRING)": ("STRING", stem_case("lower(word)")),
    "stem_bag(body STRING)": ("ARRAY<STRING>", _BAG.format("body")),
    "option_letter(body STRING)": ("STRING", f"upper(coalesce({_LETTERS}))"),
    # the bag is bound once, outside the loop over keywords
    "guard_hits(body STRING, keywords ARRAY<STRING>)": (
        "ARRAY<STRING>",
        f"transform(array({_BAG.format('body')}), b -> filter(keywords, k -> size({_TOKENS.format('k')}) > 0 AND size(array_except({_STEMS.format('k')}, b)) = 0))[0]"),
}


def register(spark: SparkSession) -> list[str]:
    """Adds word_stem, stem_bag, option_letter and guard_hits to the session; their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]

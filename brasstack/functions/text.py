"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix and the least length of what it leaves, in order of trial.
SUFFIXES = (
    ("isation", 4), ("ization", 4), ("ation", 4), ("tion", 4), ("sion", 4), ("ment", 4), ("ness", 4), ("able", 4), ("ible", 4), ("ance", 4),
    ("ence", 4), ("ment", 4), ("ings", 3), ("ally", 4), ("ful", 3), ("ous", 3), ("ive", 3), ("ing", 3), ("ise", 3), ("ize", 3), ("ate", 3),
    ("ion", 3), ("ly", 3), ("ed", 3), ("er", 3), ("es", 3), ("al", 3), ("s", 3),
)
# Patterns of an answer letter, in order of trial.
OPTION_PATTERNS = (r"(?:answer|option|choice)\s*(?:is|:)\s*\(?([A-D])\)?", r"\b([A-D])\)", r"\b([A-D])\b")
# Fixed value: characters stripped from dedup tokens.
PUNCTUATION = ".,;:!?\"'()[]{}"


def stem_case(word: str = "w") -> str:
    """The stemmer as a CASE expression that Spark and DuckDB both read; the first suffix that fits is cut."""
    arms = "".join(f" WHEN right({word}, {len(s)}) = '{s}' AND length({word}) >= {len(s) + n} THEN left({word}, length({word}) - {len(s)})" for s, n in SUFFIXES)
    return f"CASE{arms} ELSE {word} END"


def stem_word(word: str) -> str:
    """The stem of one word, for constants."""
    w = word.lower()
    return next((w[: -len(s)] for s, n in SUFFIXES if w.endswith(s) and len(w) >= len(s) + n), w)


def stem(word: Column) -> Column:
    """The first suffix that fits is cut. Only suffixes with the word's last letter are tried: the others can't fit."""
    w = F.lower(word)
    size, last, out = F.length(w), F.right(w, F.lit(1)), w
    for letter in dict.fromkeys(s[-1] for s, _ in SUFFIXES):
        found = w
        for s, n in reversed([x for x in SUFFIXES if x[0][-1] == letter]):
            found = F.when(w.endswith(s) & (size >= len(s) + n), F.left(w, size - len(s))).otherwise(found)
        out = F.when(last == letter, found).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Lower-cased ASCII alphanumeric runs."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def stem_bag(text: Column) -> Column:
    """The distinct stems of a text; each distinct token is stemmed once."""
    return F.array_distinct(F.transform(F.array_distinct(tokens(F.coalesce(text, F.lit("")))), stem))


def triggered(response: Column, keywords: Column | list[str]) -> Column:
    """The keywords, in order, all of whose stems occur in the response; keywords without tokens never do.

    Keywords are a column, or a list of constants, whose stems are then worked out once.
    """
    if isinstance(keywords, list):
        known = [(k, [stem_word(t) for t in re.findall("[a-z0-9]+", k.lower())]) for k in keywords]
        arms = lambda b: [F.when(F.size(F.array_except(F.array(*map(F.lit, ks)), b)) == 0, F.lit(k)) for k, ks in known if ks]
        bag = F.transform(F.array(stem_bag(response)), lambda b: F.array_compact(F.array(*arms(b))) if arms(b) else F.array().cast("array<string>"))
    else:
        bag = F.transform(F.array(stem_bag(response)), lambda b: F.filter(keywords, lambda k: (F.size(tokens(k)) > 0) & (F.size(F.array_except(stems(k), b)) == 0)))
    return F.coalesce(bag[0], F.array().cast("array<string>"))


def option_letter(text: Column) -> Column:
    """The answer letter of a response, or null."""
    found = [F.upper(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit(""))) for p in OPTION_PATTERNS]
    return F.coalesce(*found)


def dedup_tokens(text: Column) -> Column:
    """Distinct words of over 2 characters, lower case, without punctuation at either end."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION))))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def budget_tier(budget: Column) -> Column:
    """By substring, so a budget of 500 counts as one of 50."""
    return F.when(budget.contains("₹0"), 0).when(budget.contains("₹50"), 50).when(budget.contains("₹200"), 200).otherwise(-1)


def strip_html(html: Column) -> Column:
    """Tags become spaces, blanks are collapsed, blank lines are at most one; entities stay."""
    flat = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-]", "_")


def cache_key(url: Column, params: Column | None = None) -> Column:
    """SHA-256 of a URL and its parameters in key order."""
    if params is None:
        return F.sha2(url, 256)
    parts = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.concat(url, F.lit("?"), F.array_join(parts, "&")), 256)

"""A training corpus from documents: quality rules, exact dedup, near-dedup, secret scan, packing."""

from __future__ import annotations

from brasstack.llm import exact_dedup, packing, quality_rules, secrets, simhash
from brasstack.llm.common import cut, table


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, quality_rules.good_rows(spark, sf_dir))


def exact(spark, docs, sf_dir):
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return simhash.drop_near(docs)


def secret(spark, docs, sf_dir):
    """Every document stays; values of secrets in its text are replaced."""
    return secrets.redacted(docs)


def pack(spark, docs, sf_dir):
    """Pieces of packed sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash", near), ("secret_scan", secret), ("packing", pack)]
#: The stages learn weights, lex and tokenise; SQL has no such functions. See the brute-force tests.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs

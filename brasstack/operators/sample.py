"""Constraint spaces, stratified profiles and option shuffles that repeat by key."""

from __future__ import annotations

import functools
import hashlib
import operator
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The three constraint axes.
BUDGETS = ("₹0 budget", "₹50 budget", "₹200 budget")
ENVIRONMENTS = ("45°C Heatwave", "Monsoon Flash Flood", "Dust Storm/Arid Air")
INFRASTRUCTURES = ("Total Grid Outage", "No Internet/Cell Signal", "No Motorized Transport Access")
AXES = {"budget": BUDGETS, "environment": ENVIRONMENTS, "infrastructure": INFRASTRUCTURES}


def constraint_space(spark: SparkSession, axes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Every combination of the axes, ord from 0 with the first axis slowest."""
    axes = axes or AXES
    df = spark.range(1).select()
    for name, options in axes.items():
        df = df.select("*", F.posexplode(F.array(*map(F.lit, options))).alias(f"_{name}", name))
    ordinal = F.lit(0)
    for name, options in axes.items():
        ordinal = ordinal * len(options) + F.col(f"_{name}")
    return df.select(ordinal.cast("int").alias("ord"), *axes)


def generator(key: str) -> random.Random:
    return random.Random(int(hashlib.sha256(key.encode()).hexdigest(), 16))


def profiles_for(key: str, combos: list[tuple[str, ...]], count: int) -> list[int]:
    """Positions in combos: one for each value of each axis, the rest at random, in random order; never one twice."""
    rng, chosen = generator(key), []

    def free(test=lambda c: True):
        return [i for i, c in enumerate(combos) if i not in chosen and test(c)]

    for axis in range(len(combos[0])):
        for value in dict.fromkeys(c[axis] for c in combos):
            if fits := free(lambda c: c[axis] == value):  # noqa: B023
                chosen.append(rng.choice(fits))
    if (more := count - len(chosen)) > 0 and (rest := free()):
        chosen += rng.sample(rest, min(more, len(rest)))
    rng.shuffle(chosen)
    return chosen[:count]


def stratified_exact(seeds: DataFrame, space: DataFrame, count: int = 10) -> DataFrame:
    """seeds (seed_id) with k from 1 and one profile each, drawn as the seeded generator draws."""
    rows = space.orderBy("ord").collect()  # a constraint space, 27 rows
    names = [c for c in space.columns if c != "ord"]
    combos = [tuple(r[c] for c in names) for r in rows]

    def run(frames):
        for f in frames:
            out = [(s, k + 1, *combos[i]) for s in f["seed_id"] for k, i in enumerate(profiles_for(s, combos, count))]
            yield pd.DataFrame(out, columns=["seed_id", "k", *names])

    return seeds.select("seed_id").mapInPandas(run, "seed_id string, k int, " + ", ".join(f"{n} string" for n in names))


def stratified_hash(seeds: DataFrame, space: DataFrame, count: int = 10) -> DataFrame:
    """The same guarantees from hashes alone: the first combination of each axis value by hash, then the rest by hash.

    All of it within the seed's row, so nothing is shuffled."""
    names = [c for c in space.columns if c != "ord"]
    combos = [tuple(r[c] for c in names) for r in space.orderBy("ord").collect()]  # a constraint space, 27 rows
    own = [F.struct(F.sha2(F.concat_ws("|", "seed_id", F.lit("|".join(c))), 256).alias("h"), *[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in combos]

    def same_as(x, name):
        return lambda e: e[name] == x[name]

    def pick(all_):
        def lead(x, i):
            firsts = [~F.exists(F.slice(all_, F.lit(1), i), same_as(x, n)) for n in names]
            return F.struct((~functools.reduce(operator.or_, firsts)).alias("rest"), x["h"].alias("h"), *[x[n].alias(n) for n in names])

        return F.slice(F.array_sort(F.transform(all_, lead)), 1, count)

    # bound by a lambda, so that the hashes are worked out once and not for every element
    chosen = F.transform(F.array(F.array_sort(F.array(*own))), pick)[0]
    each = seeds.select("seed_id", F.posexplode(chosen).alias("k", "c"))
    return each.select("seed_id", (F.col("k") + 1).alias("k"), *[F.col("c")[n].alias(n) for n in names])


def shuffle_options(problems: DataFrame) -> DataFrame:
    """problem_id, options A to D in seeded order and the letter of the right one (the first of the four given)."""

    def run(frames):
        for f in frames:
            out = []
            for key, options in zip(f["problem_id"], f["options"]):
                order = list(range(4))
                generator(key).shuffle(order)
                out.append((key, *(options[i] for i in order), "ABCD"[order.index(0)]))
            yield pd.DataFrame(out, columns=["problem_id", "A", "B", "C", "D", "answer"])

    return problems.select("problem_id", "options").mapInPandas(run, "problem_id string, A string, B string, C string, D string, answer string")

"""Toxicity by weak supervision.

Lexicon voters (words) and pattern voters (word beginnings) are mined from a bounded sample of labelled rows outside
the held-out fold: labels pick the voters, and are not used after that. A generative label model estimates from the
votes alone how often each voter fires in either class and how voters are correlated (weak.label_model); its posteriors
train a linear classifier on hashed features, which scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fewest, small_batches, table
from .weak import Sparse, label_model, logistic, unlike

#: Labelled rows of either label used for learning at most: those with the smallest hash of id and label.
PER_LABEL = 8000
FEATURES = 2048
VOTERS = 128
#: Least share of label 1 among the labelled rows that a voter fires on.
PRECISION = 0.9
BUCKETS = 1 << 18
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")
_KINDS = (("w", 99), ("p", 5), ("q", 4))


def features(word: str) -> list[str]:
    return [f"{k}:{word[:n]}" for k, n in _KINDS if k == "w" or len(word) > n]


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of at most PER_LABEL rows of either label outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("y")).filter("_id IS NOT NULL AND y IN (0, 1)")
    own = own.filter(~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y"))
    own = cut(own, "labelled")
    sizes = dict(own.groupBy("y").count().collect())
    some = [fewest(own.filter(F.col("y") == k), sizes.get(k, 0), PER_LABEL) for k in (0, 1)]
    ids = F.broadcast(some[0].unionAll(some[1]))  # at most 2 * PER_LABEL rows of 12 bytes
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text")).join(ids, "_id")
    # one text of each id, however often an id repeats, and one row of each text, however often it was copied
    once = met.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    return once.groupBy("text").agg(F.max("y").alias("y"))


def _count(batches):
    for b in batches:
        pos, neg = Counter(), Counter()
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            (pos if y else neg).update({f for w in words(t) for f in features(w)})
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["f", "pos", "neg"])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float, dict]:
    """Weights of buckets, bias, and the label model's figures. Without labelled rows of both kinds, no weights and a bias below zero."""
    small_batches(docs.sparkSession)
    rows = cut(sample(docs, labels), "toxic-sample")
    n = dict(rows.groupBy("y").count().collect())
    if not n.get(0) or not n.get(1):
        return {}, -2.0, {}
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(a / (n[1] + 1 - a + 0.5)) - F.log(b / (n[0] + 1 - b + 0.5))
    counted = rows.mapInArrow(_count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    strong = counted.filter("pos + neg >= 5").withColumn("odds", odds).withColumn("z", F.abs("odds") / F.sqrt(1 / a + 1 / b))
    top = strong.orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    index = {r["f"]: i for i, r in enumerate(top)}

    def pick(batches):
        for b in batches:
            found = [sorted({index[f] for w in words(t) for f in features(w) if f in index}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column("y")], names=["x", "y"])

    got = rows.mapInArrow(pick, "x array<int>, y int").collect()  # at most 2 * PER_LABEL rows
    xs, y = [r["x"] for r in got], np.array([r["y"] for r in got])
    # those that hardly fire on label 0, most telling first, but none that says what one before it says
    voters = [i for i, r in enumerate(top) if r["z"] > 3 and r["pos"] >= PRECISION * (r["pos"] + r["neg"])]
    at = {i: j for j, i in enumerate(voters)}
    votes = np.zeros((len(xs), len(voters)))
    for k, x in enumerate(xs):
        votes[k, [at[i] for i in x if i in at]] = 1
    chosen = unlike(votes, VOTERS)
    voters, votes = [voters[j] for j in chosen], votes[:, chosen]
    post, figures = label_model(votes, n[1] / (n[0] + n[1]))
    hashed = {f: bucket(f) for f in index}
    order = {h: j for j, h in enumerate(sorted(set(hashed.values())))}
    cols = [order[hashed[r["f"]]] for r in top]
    w, bias = logistic(Sparse([sorted({cols[i] for i in x}) for x in xs], len(order)), post)
    return {h: float(w[j]) for h, j in order.items() if w[j]}, float(bias), figures | {"voters": [top[i]["f"] for i in voters], "posterior": post, "y": y}


def scored(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """(doc_id, score) of every row: a null or empty text has the score of no evidence."""
    small_batches(docs.sparkSession)

    def run(batches):
        class Weights(dict):
            def __missing__(self, word):
                if len(self) > 400_000:
                    self.clear()
                self[word] = out = sum(weights.get(bucket(f), 0.0) for f in features(word))
                return out

        known = Weights().__getitem__
        for b in batches:
            s = np.array([bias + sum(map(known, words(t))) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -60, 60))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Nulls: a null text scores as an empty one, a null id is not held out, labels with nulls are not learnt from.
    Repeated rows each get their row, of repeated labels the largest counts; an empty table gives no rows.
    """
    weights, bias, _ = learn(docs, labels)
    out = scored(docs, weights, bias)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

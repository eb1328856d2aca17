"""Quality classifier on weak labels.

Overlapping heuristic labellers vote on every document of the corpus: for, against, or not at all. The counts of vote
patterns (at most 3 to the number of labellers) are all that expectation-maximisation needs to estimate the labellers'
accuracies over the whole corpus. Posteriors then label a bounded sample, on which a linear scorer over hashed word
shapes is trained; it scores every document. A text is read once: its votes and its few features are written down, and
fitting and scoring read those.
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
from .weak import Sparse, dawid_skene, logistic

#: Documents the scorer is fitted on: those with the smallest hash of id and features.
SAMPLE = 12_000
BUCKETS = 1 << 14
_SHAPES = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]+"), "A"), (re.compile(r"\d+"), "0"))
_SHOUT = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are, runs once."""
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return re.sub(r"(.)\1+", r"\1", word)[:16]


class Shapes(dict):
    """Word to (bucket, is upper case, has symbols); filled when asked, emptied when full."""

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        s = shape(word)
        h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        self[word] = out = h, s[:1] == "A" and len(word) > 2 and word.upper() == word, sum(c in "#*$%&|<>!" for c in word) >= 1
        return out


def measure(text: str | None, shapes: Shapes) -> tuple[list[int], dict[int, float]]:
    """The labellers' votes (0 against, 1 for, 2 none) and the scorer's features of a whole text; no words, no features."""
    ws = (text or "").split()
    n = len(ws)
    if not n:
        return [0, 2, 2, 2, 2, 2, 2], {}
    counts = Counter(ws)
    feats: dict[int, float] = {}
    upper = symbols = 0
    for w, c in counts.items():
        h, up, sym = shapes[w]
        feats[h] = feats.get(h, 0.0) + c / n
        upper += c * up
        symbols += c * sym
    same = sum(map(str.__eq__, ws, ws[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    twice = 1 - len(set(lines)) / max(1, len(lines))
    ends = sum(x.rstrip()[-1:] in ".!?\"'" for x in lines) / max(1, len(lines))
    upper, symbols, pipes = upper / n, symbols / n, counts["|"] / n

    def vote(bad, good):
        return 0 if bad else 1 if good else 2

    votes = [vote(n < 3, n >= 60), vote(symbols > 0.15, symbols < 0.01), vote(upper > 0.2, upper < 0.03), vote(pipes > 0.05, pipes == 0),
             vote(same > 0.15, same < 0.02), vote(twice > 0.4, twice < 0.05), vote(ends < 0.4, ends > 0.9)]
    for k, v in enumerate((same, twice, upper, symbols, pipes, 1 - ends)):
        feats[-1 - k] = v
    return votes, {k % BUCKETS: v for k, v in feats.items()}


LABELLERS = 7


MEASURED = "doc_id long, votes string, k array<int>, v array<float>"


def _measure(batches):
    shapes = Shapes()
    for b in batches:
        m = [measure(t, shapes) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(["".join(map(str, v)) for v, _ in m], pa.string()), pa.array([list(f) for _, f in m], pa.list_(pa.int32())), pa.array([list(f.values()) for _, f in m], pa.list_(pa.float32()))],
            names=["doc_id", "votes", "k", "v"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, k, v) of every row, written: the labellers' votes, the scorer's features and their values."""
    small_batches(docs.sparkSession)
    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, MEASURED), "measured")


def learn(rows: DataFrame) -> tuple[np.ndarray, float, dict]:
    """Weights of buckets, bias, figures from measured rows. An empty corpus gives no weights."""
    got = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** LABELLERS rows
    if not got:
        return np.zeros(BUCKETS), 0.0, {}
    got.sort()
    patterns = np.array([[int(v) for v in r["votes"]] for r in got])
    post, rates, prior = dawid_skene(patterns, np.array([r["n"] for r in got]))
    label = dict(zip((r["votes"] for r in got), post.tolist(), strict=True))
    # rows of a few numbers, SAMPLE of them however ids repeat
    fit = fewest(rows, sum(r["n"] for r in got), SAMPLE).collect()
    if not fit:
        return np.zeros(BUCKETS), 0.0, {}
    y = np.array([label[r["votes"]] for r in fit])
    x = Sparse([r["k"] for r in fit], BUCKETS, [r["v"] for r in fit])
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-3), 0.5 / max((y < 0.5).mean(), 1e-3))
    w, b = logistic(x, y, weight, l2=1e-5, l1=1e-5, steps=600)
    return w, b, {"accuracies": rates, "prior": prior, "posterior": label}


def quality(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher is better), kept (score of 0.5 or more).

    Null texts are empty texts, of score 0; null ids are scored but not learnt from; repeated rows
    each get their row; an empty table gives no rows; other columns are not read.
    """
    rows = measured(docs)
    w, b, _ = learn(rows)

    def run(batches):
        for batch in batches:
            k, v = batch.column("k"), batch.column("v")
            sizes = np.diff(k.offsets.to_numpy())
            s = np.bincount(np.repeat(np.arange(len(k)), sizes), w[k.flatten().to_numpy()] * v.flatten().to_numpy(zero_copy_only=False).astype(float), len(k)) + b
            s[sizes == 0] = -60.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -60, 60))))], names=["doc_id", "score"])

    return rows.select("doc_id", "k", "v").mapInArrow(run, "doc_id long, score double").withColumn("kept", F.col("score") >= 0.5)


def op2_quality_model(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))

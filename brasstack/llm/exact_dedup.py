"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition becomes a run: its digests sorted, one entry per digest with the smallest id and the number
of rows. Runs are merged in binomial rounds: in a round, FAN_IN neighbouring runs meet and a multiway merge of their
sorted entries keeps the smallest id of each digest. The digest space is cut into shards, so each round's merges
spread over the cluster and no task ever holds all digests. A hot text is one entry a run, however many copies it has.
At every level entries with one SHA-256 must agree in a second, independent hash and in length, else the merge raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import back, cut, lean, long_id, stay, table

#: Runs that one merge takes.
FAN_IN = 8
WHITE = "[\\x20\\x09-\\x0D]+"
RUN = "shard int, run int, sha binary, id long, row long, check long, chars long, n long"


def normalised(text: str = "text"):
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def _merge(first: bool):
    """Combines neighbours of equal (shard, run, digest) in a sorted stream; holds one batch and one open entry."""

    def entries(b: pa.RecordBatch, run0: int):
        n = b.num_rows
        # in native byte order, which arrays keep when they are joined; only equality is asked of the numbers
        sha = np.frombuffer(b"".join(b.column("sha").to_pylist()), np.uint64).reshape(n, 4)
        cols = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("shard", "id", "row", "check", "chars", "n")}
        cols["run"] = np.full(n, run0, np.int32) if first else b.column("run").to_numpy(zero_copy_only=False)
        return sha, cols

    def fold(sha, c):
        new = np.ones(len(sha), bool)
        new[1:] = (sha[1:] != sha[:-1]).any(1) | (c["shard"][1:] != c["shard"][:-1]) | (c["run"][1:] != c["run"][:-1])
        at = np.flatnonzero(new)
        lead = np.cumsum(new) - 1
        for k in ("check", "chars"):
            if (c[k] != c[k][at][lead]).any():
                raise ValueError("two different texts have one SHA-256 digest")
        out = {k: c[k][at] for k in ("shard", "run", "id", "row", "check", "chars")}  # sorted by id and row: the first is the least
        out["n"] = np.add.reduceat(c["n"], at)
        return sha[at], out

    @lean
    def run(batches):
        run0 = TaskContext.get().partitionId() if first else -1
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            sha, c = entries(b, run0)
            if held is not None:
                sha = np.concatenate([held[0], sha])
                c = {k: np.concatenate([held[1][k], c[k]]) for k in c}
            sha, c = fold(sha, c)
            held = sha[-1:], {k: v[-1:] for k, v in c.items()}
            if len(sha) > 1:
                yield arrow(sha[:-1], {k: v[:-1] for k, v in c.items()})
        if held is not None:
            yield arrow(*held)

    def arrow(sha, c):
        raw = np.ascontiguousarray(sha).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(c["shard"], pa.int32()), pa.array(c["run"], pa.int32()), pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
             *(pa.array(c[k], pa.int64()) for k in ("id", "row", "check", "chars", "n"))],
            names=["shard", "run", "sha", "id", "row", "check", "chars", "n"])

    return run


def digests(docs: DataFrame) -> DataFrame:
    """(id, row, sha, check, chars) of every row: the id (NO_ID for null), a number of its own, SHA-256 of the normalised text,
    a second hash, its length. Written before use: the numbers must not be dealt twice."""
    return docs.select(long_id().alias("id"), F.monotonically_increasing_id().alias("row"), normalised().alias("t")).select(
        "id", "row", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("check"), F.length("t").cast("long").alias("chars"))


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(sha, keep, keep_row, n) for every digest of digests(): the least id, the least number among its rows, the number of rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 8 * parts
    keyed = rows.select(
        F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("run"), "sha", "id", "row", "check", "chars", F.lit(1).cast("long").alias("n"))
    runs = keyed.sortWithinPartitions("shard", "sha", "id", "row").mapInArrow(_merge(True), RUN)
    left = max(1, rows.rdd.getNumPartitions())
    while left > 1:
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(parts, "shard", "run")
        runs = runs.sortWithinPartitions("shard", "run", "sha", "id", "row").mapInArrow(_merge(False), RUN)
        left = -(-left // fan_in)
    return runs.select("sha", F.col("id").alias("keep"), F.col("row").alias("keep_row"), "n")


def _met(docs: DataFrame) -> DataFrame:
    """digests() of docs with keep, keep_row and n. The join's exchanges are its own, so one that holds a hot text may be split."""
    rows = cut(digests(docs), "digests")
    return rows.join(cut(tree_merge(rows), "merged"), "sha")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. Null ids sort after all others: they stay only where a whole group has none. Of rows
    that repeat both id and text exactly one is kept. An empty table gives no rows; other columns are not read.
    """
    return _met(docs).select(
        back(F.col("id")).alias("doc_id"), back(F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names."""
    found = cut(_met(docs).select(F.col("id").alias("_id"), F.col("sha").alias("_key"), (F.col("id") == F.col("keep")).alias("first")), "found")
    lost = cut(found.filter("not first").select("_id", "_key").distinct(), "lost")
    twice = cut(found.filter("first").groupBy("_id", "_key").count().filter("count > 1").select("_id", "_key"), "twice")
    return stay(docs, F.unhex(F.sha2(normalised(), 256)), lost, twice)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

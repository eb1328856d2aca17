"""What the operators of this folder share: reading, counted broadcasts, filters by row key."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasstack.scratch import cut

#: Stands for a null id inside an operator, so that it sorts last.
NO_ID = 2**63 - 1
#: Most rows of a two-column table that may be broadcast, once they are counted.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted_broadcast(df: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, marked for broadcast only if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def long_id(col: str = "doc_id"):
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def back(col):
    """A null where long_id put NO_ID."""
    return F.when(col != NO_ID, col)


def keyed(docs: DataFrame, key: Column) -> DataFrame:
    """(_row, _id, _key): a row's columns in a struct, whatever their names, and what tells it from others."""
    return docs.select(F.struct(*docs.columns).alias("_row"), long_id().alias("_id"), key.alias("_key"))


def stay(docs: DataFrame, key: Column, lost: DataFrame, twice: DataFrame) -> DataFrame:
    """The rows of docs without those of lost (_id, _key); of rows that repeat an entry of twice (_id, _key) one stays.

    Few entries are broadcast once counted, else both sides are shuffled by both columns.
    """
    on, rows = ["_id", "_key"], keyed(docs, key)
    out = rows.join(counted_broadcast(lost), on, "left_anti")
    if not twice.isEmpty():
        few = counted_broadcast(twice)
        one = rows.join(few, on, "left_semi").groupBy(*on).agg(F.first("_row").alias("_row"))
        out = out.join(few, on, "left_anti").select("_row").unionByName(one.select("_row"))
    return out.select("_row.*")


def fewest(rows: DataFrame, size: int, n: int) -> DataFrame:
    """The n of about `size` written rows with the smallest hash of all their columns, ties by the columns themselves.

    Rows far above the expected cut are left out first, so that partitions don't each send n rows to one place; where
    rows repeat so often that fewer than n came, all are ordered.
    """
    key = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))
    if size > 4 * n:
        some = rows.filter(key < int(2 * n / size * (1 << 40)))
        rows = some if some.count() >= n else rows
    return rows.orderBy(key, *rows.columns).limit(n)


def lean(run):
    """A function for mapInArrow that gives freed memory back to the system when its task ends. Spark keeps Python workers
    for later tasks, and those that one stage leaves idle stand beside the workers of the next."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def small_batches(spark: SparkSession, most_bytes: int = 16 << 20) -> None:
    """Bound Arrow batches for long texts, where the session's own bounds are wider; narrower ones stay.

    A plan reads these settings when it runs, so they must hold in the session of its tables.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = spark.conf.get(key)
        n = int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else 0
        if n <= 0 or n > most:
            spark.conf.set(key, str(most))

"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may do without: one folder of this process serves it then."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault("dir", tempfile.mkdtemp(prefix="brasstack-"))


def path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: a lost executor then costs no recomputation,
    and joins on it get their own exchanges, which adaptive execution may split."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*written: DataFrame) -> None:
    """Delete tables of cut() that nothing will read any more."""
    for df in written:
        _delete(df.sparkSession, df._scratch)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written here; results that still read from it must have been written elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")

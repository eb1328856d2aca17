"""Incremental completion runs: new rows are worked on once, and written by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasstack.operators.select import remaining

KEYS = ["model_name", "mode", "problem_id"]


def resume_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work) -> int:
    """Takes what is new in source, drops keys already in sink, applies work, appends. Returns the rows in sink.

    foreachBatch may run a batch twice; the anti join against the sink makes the second harmless.
    """

    def batch(df: DataFrame, _: int) -> None:
        fresh = df.dropDuplicates(KEYS)
        try:
            done = spark.read.parquet(sink)
        except Exception as e:  # the sink doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        if done is not None:
            fresh = remaining(fresh, done, KEYS)
        work(fresh).write.mode("append").parquet(sink)

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).count()


def rate_windows(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    """Calls (provider, ts) a minute against quotas (provider, per_minute)."""
    counted = calls.groupBy("provider", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.join(quotas, "provider").select("provider", F.col("w.start").alias("minute"), "calls", (F.col("calls") > F.col("per_minute")).alias("over"))

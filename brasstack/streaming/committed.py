"""A sink that holds each key once: batches are written aside and count from the moment a numbered log names them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasstack.streaming.resume import KEYS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "version long, writer string, batch long, attempt string"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, not on the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class CommitLog:
    """Files root/_log/<version>, each naming one written attempt; a version belongs to the writer whose rename makes it.

    Renaming without overwriting is atomic on HDFS and the like; a local file system leaves a short gap between its look and the move.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.seen = spark, root, []
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.fs.Path(f"{self.root}/{name}")

    def entries(self) -> list:
        """What is committed, by version; of the files those not seen yet are read."""
        folder = self._path("_log")
        system = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        last = self.seen[-1]["version"] if self.seen else -1
        new = sorted(n for n in names if re.fullmatch(r"\d{12}", n) and int(n) > last)
        if new:
            self.seen += sorted(self.spark.read.schema(_ENTRY).json([f"{self.root}/_log/{n}" for n in new]).collect(), key=lambda e: e["version"])  # a row a batch
        return self.seen

    def commit(self, version: int, writer: str, batch: int, attempt: str) -> bool:
        """Whether the version could be taken."""
        folder, temp, to = self._path("_log"), self._path(f"_log/.{uuid.uuid4().hex}"), self._path(f"_log/{version:012d}")
        system = folder.getFileSystem(self.conf)
        system.mkdirs(folder)
        out = system.create(temp, False)
        out.write(bytearray(json.dumps({"version": version, "writer": writer, "batch": batch, "attempt": attempt}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        try:
            self.fs.FileContext.getFileContext(folder.getFileSystem(self.conf).getUri(), self.conf).rename(temp, to, none)
        except Py4JJavaError as e:
            system.delete(temp, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def rows(self, entries: list) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/{e['attempt']}" for e in entries]) if entries else None

    def delete(self, attempt: str) -> None:
        at = self._path(attempt)
        at.getFileSystem(self.conf).delete(at, True)


def committed(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of all committed batches; None before the first. What a killed batch has written isn't read."""
    log = CommitLog(spark, root)
    return log.rows(log.entries())


def append_batch(rows: DataFrame, log: CommitLog, writer: str, batch: int, work: Callable[[DataFrame], DataFrame], keys: list[str] = KEYS, own: bool = False) -> bool:
    """Works on the rows whose keys nobody has committed, and commits the result; False if this batch is in the log already.

    Keys of other writers' batches are read, those of the writer's own only with own=True: its stream has them as state.
    If other writers commit meanwhile, only what they added is looked at, and the written result loses those keys.
    Rows with a null in their keys are of one key with those that have the same.
    """
    spark, attempt, checked = log.spark, None, -1
    while True:
        entries = log.entries()
        if any(e["writer"] == writer and e["batch"] == batch for e in entries):
            if attempt:
                log.delete(attempt)
            else:  # a stream's batch that is run again must still bring its state forward
                rows.write.format("noop").mode("overwrite").save()
            return False
        held = log.rows([e for e in entries if e["version"] > checked and (own or e["writer"] != writer)])
        if attempt is None or held is not None:
            todo = rows.dropDuplicates(keys) if attempt is None else spark.read.parquet(f"{log.root}/{attempt}")
            if held is not None:
                met = held.select(*[F.col(k).alias(f"_{k}") for k in keys])
                todo = todo.join(met, [todo[k].eqNullSafe(met[f"_{k}"]) for k in keys], "left_anti")
            old, fresh = attempt, f"data/{uuid.uuid4().hex}"
            (work(todo) if old is None else todo).write.parquet(f"{log.root}/{fresh}")
            attempt = fresh
            if old:
                log.delete(old)
        checked = entries[-1]["version"] if entries else -1
        if log.commit(checked + 1, writer, batch, attempt):
            return True


def exactly_once(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, writer: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Takes what is new in source and commits each key once, whatever is killed and started again and whoever else writes.

    The keys that this writer has seen are the stream's state, so a batch doesn't read the writer's own part of the sink.
    A writer name belongs to one checkpoint.
    """
    log = CommitLog(spark, root)
    with state_on_disk(spark):
        stream = spark.readStream.schema(schema).parquet(source).dropDuplicates(KEYS)
        q = (stream.writeStream.foreachBatch(lambda df, k: append_batch(df, log, writer, k, work) and None)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()

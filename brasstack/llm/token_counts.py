"""Token counts as delta-maintained rollups.

A ledger holds signed rows by document and tokenizer version; a batch appends to it and to the totals. An insert adds a
document's counts, a delete takes away what the ledger holds for it, a revision does both. Totals by source, language
and tokenizer version are sums of the batches' deltas, so nothing is counted again. A batch is committed by the
success mark of its delta: applying it once more, or after a crash half way, changes nothing that is committed and
overwrites what isn't.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ByteBPE, WordBPE
from brasstack.scratch import path

from .common import cut, small_batches, table

LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, chars long"
#: Folders of a ledger batch by hash of the id: a later batch reads only those that its ids fall into.
BUCKETS = 16
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]


def public_versions() -> dict[str, tuple[str, str, str]]:
    """Tokenizer versions by name: kind, file, pattern."""
    import public_tokenizers as P

    return {"word_bpe_49k@1": ("word", P.path("word_bpe_49k.json"), ""), "byte_bpe_50k@1": ("byte", P.path("byte_bpe_50k.tiktoken"), P.PATTERN)}


def counted(docs: DataFrame, versions: dict[str, tuple[str, str, str]]) -> DataFrame:
    """A ledger row for each input row and tokenizer version. Null texts count as empty; null keys stay null."""
    small_batches(docs.sparkSession)

    def run(batches):
        made = {}
        for name, (kind, path, pattern) in versions.items():
            tok = WordBPE(path) if kind == "word" else ByteBPE(path, pattern)
            made[name] = (lambda ts, t=tok: [len(b) // 4 for b in t.encode(ts)]) if kind == "word" else tok.counts
        for b in batches:
            texts = b.column("text").to_pylist()
            chars = pa.array([len(t or "") for t in texts], pa.int64())
            for name, count in made.items():
                n = b.num_rows
                cols = [b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([name] * n, pa.string()), pa.array([1] * n, pa.int64()), pa.array(count(texts), pa.int64()), chars]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *KEYS, *SUMS])

    return docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("source", "lang", "text"))).mapInArrow(run, LEDGER)


def bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


class Rollup:
    """Totals kept under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _committed(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/delta")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(b for b in found if self._exists(f"{self.root}/delta/{b}/_SUCCESS"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        out = None
        for b in self._committed():  # each batch has its own folders by bucket
            one = self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{b}")
            out = one if out is None else out.unionAll(one)
        return self.spark.createDataFrame([], schema) if out is None else out

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER + ", bucket int")

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Commit a batch; False if it was committed before. inserts and revisions: ledger rows; deletes: doc_id.

        A delete or revision of an unknown document takes nothing away. Rows with a null doc_id can be inserted only:
        as deletes and revisions they have no effect.
        """
        if self._exists(f"{self.root}/delta/{batch}/_SUCCESS"):
            return False
        revisions = None if revisions is None else revisions.filter("doc_id IS NOT NULL")
        parts = [x.select("doc_id", *KEYS, *SUMS) for x in (inserts, revisions) if x is not None]
        gone = [x.select("doc_id") for x in (deletes, revisions) if x is not None]
        if gone:
            ids = gone[0] if len(gone) == 1 else gone[0].unionAll(gone[1])
            ids = ids.filter("doc_id IS NOT NULL").distinct()
            touched = [r[0] for r in ids.select(bucket().alias("b")).distinct().collect()]  # at most BUCKETS
            held = self.ledger().filter(F.col("bucket").isin(touched)).join(ids, "doc_id", "left_semi")
            held = held.groupBy("doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).filter("docs <> 0 OR tokens <> 0 OR chars <> 0")
            parts.append(held.select("doc_id", *KEYS, *(-F.col(c) for c in SUMS)).toDF("doc_id", *KEYS, *SUMS))
        rows = parts[0] if parts else self.spark.createDataFrame([], LEDGER)
        for x in parts[1:]:
            rows = rows.unionAll(x)
        # one row for each id and key, none without effect; rows without an id become one for each key, so no bucket is hot
        rows = rows.groupBy("doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).filter("docs <> 0 OR tokens <> 0 OR chars <> 0")
        rows.withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER + ", bucket int").parquet(f"{self.root}/ledger/{batch}")
        delta = written.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        delta.write.mode("overwrite").parquet(f"{self.root}/delta/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars; keys whose rows are all gone are left out."""
        delta = self._read("delta", "source string, lang string, tokenizer string, docs long, tokens long, chars long")
        out = delta.groupBy(*KEYS).agg(*(F.sum(c).alias("n_" + c) for c in SUMS))
        return out.filter("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents through every kind of batch, each sent twice as after a lost answer; the second has no effect.

    Those with an id are loaded with provisional counts (a token for every four characters), revised to the counted ones and
    deleted; then all are inserted, so the totals are those of the documents.
    """
    docs = table(spark, sf_dir, "documents")
    roll, rows = Rollup(spark, path(spark, "rollup")), cut(counted(docs, public_versions()), "counted")
    for _ in range(2):
        roll.apply("1-load", inserts=rows.filter("doc_id IS NOT NULL").withColumn("tokens", F.expr("chars div 4")))
    for _ in range(2):
        roll.apply("2-count", revisions=rows)
    for _ in range(2):
        roll.apply("3-recall", deletes=docs.select(F.col("doc_id").cast("long")))
    for _ in range(2):
        roll.apply("4-restore", inserts=rows)
    return roll.totals()

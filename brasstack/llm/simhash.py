"""SimHash near-dedup on pigeonhole blocks.

Two 64-bit fingerprints that differ in at most 2 bits agree in 3 at least of 5 blocks. Every distinct fingerprint is
therefore written under each of the 10 ways to choose 3 blocks (about 38 bits), fingerprints with one key meet, and
Hamming distance is verified inside the group. A group of more than GROUP fingerprints isn't compared as it stands:
its free bits are cut into 3 sub-blocks, of which close pairs share one, and so on (the same argument, so no link is
lost), until groups are small. Verified links leave a group as a spanning forest, never as all pairs. Components come
from alternating large-star and small-star rounds, written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstack.scratch import drop

from .common import BROADCAST_ROWS, back, cut, lean, long_id, small_batches, stay, table

BITS = 2
WORDS = 3
WIDTHS = (13, 13, 13, 13, 12)
#: Most fingerprints compared pair by pair in one group; the last level has at most 12 free bits.
GROUP = 1024
LEVELS = 3
#: Rows of a group that are compared with all of it at once.
TILE = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text's word shingles; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        flat = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[s:e], 42) for s, e in zip([0, *[e + 1 for e in ends]], ends[WORDS - 1 :])]
    return _majority(hashes)


def _majority(hashes: list[int]) -> int:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        h = np.array(hashes[i : i + 65536], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


@lean
def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fps, pa.int64())], names=["id", "th", "fp"])


def text_hash():
    """Tells texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, th, fp) of every row; th is a hash of the text, fp the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select(long_id().alias("id"), text_hash().alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "id long, th long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(free: list[int], widths) -> list[int]:
    out, at = [], 0
    for w in widths:
        out.append(sum(1 << b for b in free[at : at + w]))
        at += w
    return out


def block_masks() -> list[int]:
    return [a | b | c for a, b, c in combinations(_bits(list(range(64)), WIDTHS), 3)]


def sub_masks(mask: int) -> list[int]:
    """The mask with each third of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = len(free)
    return [mask | part for part in _bits(free, (-(-n // 3), -(-(n - 1) // 3), -(-(n - 2) // 3)))]


@lean
def _verify(batches):
    """Star links of the components that distances of at most BITS make within each group, compared TILE rows at a time."""
    for b in batches:
        left, right = [], []
        for group in b.column("group").to_pylist():
            v = np.array(group, np.int64)
            fp = v.view(np.uint64)
            root = np.arange(len(v))
            while True:
                low = np.empty_like(root)
                for i in range(0, len(v), TILE):
                    near = np.bitwise_count(fp[i : i + TILE, None] ^ fp[None, :]) <= BITS
                    low[i : i + TILE] = np.where(near, root[None, :], len(v)).min(1)
                low = low[low]
                if (low == root).all():
                    break
                root = low
            far = np.flatnonzero(root != np.arange(len(v)))
            left += v[far].tolist()
            right += v[root[far]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _groups(keyed: DataFrame) -> DataFrame:
    grouped = keyed.groupBy("m", "key").agg(F.sort_array(F.collect_list("fp")).alias("group"))
    return grouped.filter(F.size("group") > 1).select("group").mapInArrow(_verify, "a long, b long")


def links(vertices: DataFrame) -> DataFrame:
    """(a, b), a > b: verified links between the distinct fingerprints (fp) of vertices; their closure is complete."""
    spark = vertices.sparkSession
    masks, found, rows = block_masks(), [], vertices.withColumn("m0", F.lit(0))
    options = {0: list(range(len(masks)))}
    for level in range(LEVELS):
        choice = F.lit(None)
        for m0, ms in options.items():
            keys = F.array(*[F.struct(F.lit(m).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(masks[m]))).alias("key")) for m in ms])
            choice = F.when(F.col("m0") == m0, keys).otherwise(choice) if len(options) > 1 else keys
        keyed = rows.select("fp", F.explode(choice).alias("k")).select("fp", "k.m", "k.key")
        if level == LEVELS - 1:
            found.append(_groups(keyed))
            break
        hot = cut(keyed.groupBy("m", "key").count().filter(F.col("count") > GROUP).select("m", "key"), "hot")
        n_hot = hot.count()
        if not n_hot:
            found.append(_groups(keyed))
            break
        on = ["m", "key"]
        if n_hot <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        else:  # salted on both sides, so a hot key's rows spread
            on = ["m", "key", "salt"]
            keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(32)))
            hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
        found.append(_groups(keyed.join(hot, on, "left_anti")))
        rows = cut(keyed.join(hot, on, "left_semi").select("fp", F.col("m").alias("m0")), "crowded")
        options, old = {}, masks
        masks = []
        for m0, mask in enumerate(old):
            options[m0] = list(range(len(masks), len(masks) + 3))
            masks += sub_masks(mask)
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b) but the roots; root is the smallest vertex of the component."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        for star in ("large", "small"):
            if star == "large":
                near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            else:
                near = edges
            least = cut(near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
            met = near.join(least, "a")
            if star == "large":
                moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            else:
                moved = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
            old, edges = edges, cut(moved.filter("a <> b").distinct(), "edges")
            drop(old, least)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = now


def _met(docs: DataFrame) -> DataFrame:
    """(id, th, fp, first) of every row: first is the least (id, th) of its component, th a hash of the text."""
    fps = cut(fingerprints(docs), "fps")
    vertices = cut(fps.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("first")), "vertices")
    roots = components(links(vertices.select("fp")))
    # fingerprints are the vertices, so rows without an id join nothing to each other
    rooted = cut(vertices.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = cut(rooted.select("fp", "root").join(first, "root").select("fp", "first"), "named")
    # both sides of this join have exchanges of their own: one hot fingerprint may be split
    return fps.join(named, "fp")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    A null or empty text has fingerprint zero and links like any other. Null ids count as larger than all others: a
    component of which no row has an id gets a null component_id. Repeated rows each get their row; an empty table gives
    none; other columns are not read.
    """
    return _met(docs).select(
        back(F.col("id")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back(F.col("first.id")).alias("component_id"))


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns, whatever their names: that of the smallest id, where ids repeat
    or are null that of the smallest text hash; of rows that repeat both one stays."""
    found = cut(_met(docs).select(F.col("id").alias("_id"), F.col("th").alias("_key"), F.expr("id = first.id AND th = first.th").alias("stays")), "found")
    lost = cut(found.groupBy("_id", "_key").agg(F.bool_or("stays").alias("stays")).filter("not stays").select("_id", "_key"), "lost")
    twice = cut(found.filter("stays").groupBy("_id", "_key").count().filter("count > 1").select("_id", "_key"), "twice")
    return stay(docs, text_hash(), lost, twice)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))

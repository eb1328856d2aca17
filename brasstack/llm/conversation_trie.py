"""Prefix trie of rebuilt conversations by MSD radix partitioning over dictionary-encoded turn ids.

Turns (role, text) get ids from a dictionary. A bucket holds the conversations below one node; the first holds all. A
round looks at every bucket of more than LOCAL turns: it finds how far its members agree (their chain of nodes), emits
the chain, and deals the members by their next turn id into child buckets. A child of one conversation is a plain tail
and needs no sorting; one of at most LOCAL turns goes to a single task, where a multikey quicksort finishes it and
emits its nodes; the others are dealt again. Since a round follows a whole chain, copies of a long conversation take
one. What subtrees add up to is then summed from the last round to the first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasstack.operators.select import number

from .common import cut, table

#: Most turns and members of a bucket that one task sorts.
LOCAL = 10_000
#: Own turns of another conversation that a rebuilt one may begin with, and conversations of a family.
HEADS, FAMILY = 9, 5
#: Ids in one piece of the text that is hashed.
RUN = 20_000
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


PIECE = "conv_id long, depth long, first long, piece string"
DIGEST = "conv_id long, depth long, ends_sha256 string"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(cols, names, strict=True)], names=[k for k, _ in names])


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv, nth, size, tid, bytes): every turn with its place from 1 in its conversation, the conversation's number of
    turns, the turn's id in the dictionary and the UTF-8 bytes of its text.

    Order is by turn, null first; ties by the SHA-256 of role and text. Places come from a global numbering, so a
    conversation that holds many of all rows is still spread over tasks.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").cast("long").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.octet_length(text("text")).cast("long").alias("bytes"),
        F.unhex(F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256)).alias("digest"))
    placed = cut(number(rows, ["conv", "turn", "digest"]), "placed")
    words = cut(placed.groupBy("digest").agg(F.first("bytes").alias("_b")).select("digest", F.monotonically_increasing_id().alias("tid")), "dictionary")
    starts = cut(placed.groupBy("conv").agg((F.min("position") - 1).alias("before"), F.count(F.lit(1)).alias("size")), "starts")
    met = placed.select("conv", "position", "bytes", "digest").join(words, "digest").join(starts, "conv")
    return met.select("conv", (F.col("position") - F.col("before")).alias("nth"), "size", "tid", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, tid, bytes) of the rebuilt conversations, and (conv, len) of all of them, turnless ones too."""
    sizes = cut(turns.groupBy("conv").agg(F.first("size").alias("size")), "sizes")
    heads = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS))
    own = sizes.select("conv", "size", heads.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    plan = cut(own.join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken"), "size"), "plan")
    tails = turns.join(plan.select("conv", "h", "taken"), "conv").filter("nth > h").select("conv", (F.col("taken") + F.col("nth") - F.col("h")).alias("depth"), "tid", "bytes")
    first = turns.filter(F.col("nth") < HEADS).select(F.col("conv").alias("base"), F.col("nth").alias("depth"), "tid", "bytes")
    begun = first.join(plan.select("conv", "base", "h"), "base").filter("depth <= h").select("conv", "depth", "tid", "bytes")
    length = F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    return tails.unionByName(begun), plan.select("conv", length.cast("long").alias("len"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, conv): hashes of ascending ids. Sorted partitions write
    pieces of the text, and one pass over the pieces of a node updates its hash, so memory is bounded whatever its ids."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        key, ids = None, []
        for b in batches:
            out = []
            for c, d, x in zip(*(b.column(k).to_pylist() for k in ("conv_id", "depth", "conv")), strict=True):
                if ids and ((c, d) != key or len(ids) >= RUN):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = c, d
                ids.append(x)
            yield _arrow(out, PIECE)
        yield _arrow([(*key, ids[0], ",".join(map(str, ids)))] if ids else [], PIECE)

    def digests(batches):
        key, h = None, None
        for b in batches:
            out = []
            for c, d, piece in zip(*(b.column(k).to_pylist() for k in ("conv_id", "depth", "piece")), strict=True):
                if (c, d) == key:
                    h.update(b"," + piece.encode())
                else:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = (c, d), hashlib.sha256(piece.encode())
            yield _arrow(out, DIGEST)
        yield _arrow([(*key, h.hexdigest())] if key else [], DIGEST)

    sorted_ = ends.repartitionByRange(n, "conv_id", "depth", "conv").sortWithinPartitions("conv_id", "depth", "conv")
    written = cut(sorted_.mapInArrow(pieces, PIECE), "pieces")
    return written.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digests, DIGEST)


def multikey_nodes(convs: list[int], turns: list[list[int]], sizes: list[list[int]], level: int, parent: int | None, top_bytes: int) -> list[tuple]:
    """Nodes of one bucket: NODE's columns. Members share a node at depth `level`; turns and sizes are what follows it.

    Three-way radix quicksort on turn ids, one position at a time, with a stack of its own. The part that equals the
    pivot is a node of the trie; a conversation that has ended sorts before all others.
    """
    n = len(convs)
    order = list(range(n))
    nodes = [[min(convs), level, parent, n, 0, 0, (n - 1) * top_bytes, None, -1]]  # NODE's columns and the parent's place
    todo = [(0, n, 0, 0)]
    while todo:
        lo, hi, d, at = todo.pop()
        part = order[lo:hi]
        keys = [turns[i][d] if d < len(turns[i]) else -1 for i in part]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(part, keys, strict=True) if k < pivot]
        same = [i for i, k in zip(part, keys, strict=True) if k == pivot]
        more = [i for i, k in zip(part, keys, strict=True) if k > pivot]
        order[lo:hi] = less + same + more
        a, b = lo + len(less), lo + len(less) + len(same)
        if less:
            todo.append((lo, a, d, at))
        if more:
            todo.append((b, hi, d, at))
        if pivot < 0:
            nodes[at][7] = sorted(convs[i] for i in same)
        else:
            nodes[at][4] += 1
            nodes.append([min(convs[i] for i in same), nodes[at][1] + 1, nodes[at][0], len(same), 0, 0, (len(same) - 1) * sizes[same[0]][d], None, at])
            todo.append((a, b, d + 1, len(nodes) - 1))
    for node in reversed(nodes):  # a node stands behind its parent
        node[5] = node[5] or 1
        if node[8] >= 0:
            nodes[node[8]][5] += node[5]
            nodes[node[8]][6] += node[6]
    return [(*x[:7], hashlib.sha256(",".join(map(str, x[7])).encode()).hexdigest() if x[7] else NONE) for x in nodes]


def _finish(batches):
    """Sorted rows (bucket, conv, depth, tid, bytes, parent): of each member first its bucket's own node (tid -1), then what follows."""
    out, bucket, convs, turns, sizes = [], None, [], [], []
    for b in batches:
        for k, c, d, t, s, p in zip(*(b.column(x).to_pylist() for x in ("bucket", "conv", "depth", "tid", "bytes", "parent")), strict=True):
            if k != bucket:
                if convs:
                    out += multikey_nodes(convs, turns, sizes, *top)
                bucket, convs, turns, sizes, top = k, [], [], [], (d, p, s)
                if len(out) > 4096:
                    yield _arrow(out, NODE)
                    out = []
            if t < 0:
                convs.append(c)
                turns.append([])
                sizes.append([])
            else:
                turns[-1].append(t)
                sizes[-1].append(s)
    if convs:
        out += multikey_nodes(convs, turns, sizes, *top)
    yield _arrow(out, NODE)


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node: NODE's columns.

    A null role or text is empty, a null turn comes first, equal turns are ordered by SHA-256 of role and text, and
    rows that repeat each other are turns of their own. Rows without conv_id belong to no conversation and are left
    out. Very long texts are hashed and counted whole. An empty table has no members, so it gives no root either.
    Other columns are not read.
    """
    spark = conversations.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = cut(encoded(conversations), "turns")
    rows, lens = (cut(x, name) for x, name in zip(rebuilt(turns), ("rebuilt", "lengths"), strict=True))
    whole = lens.agg(F.min("conv").alias("bucket"), F.count(F.lit(1)).alias("m"), F.sum("len").alias("turns")).first()
    if not whole["m"]:
        return spark.createDataFrame([], NODE)
    # members of buckets: the bucket's smallest conversation and the depth of its first node tell it from others
    top = {"bucket": F.lit(whole["bucket"]), "level": F.lit(0).cast("long"), "parent": F.lit(None).cast("long"), "top_bytes": F.lit(0).cast("long"), "m": F.lit(whole["m"]), "turns": F.lit(whole["turns"])}
    small = (F.col("m") <= local) & (F.col("turns") <= local)
    members = lens.select("conv", "len", *[v.alias(k) for k, v in top.items()])
    finish, single, rounds = [members.filter(small)], [], []
    active = cut(members.filter(~small), "members")
    while not active.isEmpty():
        rest = rows.join(active.select("conv", "bucket", "level"), "conv").filter("depth > level").select("bucket", "conv", "depth", "tid", "bytes")
        info = active.groupBy("bucket").agg(*[F.first(k).alias(k) for k in ("level", "parent", "top_bytes", "m")], F.max("len").alias("longest"))
        by_depth = cut(rest.groupBy("bucket", "depth").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count(F.lit(1)).alias("k"), F.max("bytes").alias("bytes")), "depths")
        met = by_depth.join(info.select("bucket", "m"), "bucket")
        stops = met.filter("a <> b OR k < m").groupBy("bucket").agg(F.min("depth").alias("stop"))
        info = cut(info.join(stops, "bucket", "left").withColumn("last", F.coalesce(F.col("stop") - 1, F.col("longest"))), "buckets")
        dealt = rest.join(info.select("bucket", "stop", "parent"), "bucket").filter("depth = stop").join(active.select("conv", "len"), "conv")
        dealt = cut(dealt.select("bucket", "conv", "tid", "bytes", "stop", "len"), "dealt")
        kids = cut(dealt.groupBy("bucket", "tid").agg(
            F.min("conv").alias("kid"), F.count(F.lit(1)).alias("m"), F.sum(F.col("len") - F.col("stop")).alias("turns"), F.max("bytes").alias("top_bytes"), F.first("stop").alias("level")), "kids")
        ends = active.join(info.select("bucket", "last"), "bucket").filter("len = last").select(F.col("bucket").alias("conv_id"), F.col("last").alias("depth"), "conv")
        rounds.append((info, by_depth, kids, ends))
        members = dealt.select("bucket", "tid", "conv", "len").join(kids, ["bucket", "tid"]).select(
            "conv", "len", F.col("kid").alias("bucket"), "level", F.col("bucket").alias("parent"), "top_bytes", "m", "turns")
        members = cut(members, "members")
        single.append(members.filter("m = 1"))
        finish.append(members.filter("m > 1").filter(small))
        active = members.filter("m > 1").filter(~small)

    def union(frames):
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    todo = union(finish)
    heads = todo.select("bucket", "conv", F.col("level").alias("depth"), F.lit(-1).cast("long").alias("tid"), F.col("top_bytes").alias("bytes"), "parent")
    after = rows.join(todo.select("conv", "bucket", "level", "parent"), "conv").filter("depth > level").select("bucket", "conv", "depth", "tid", "bytes", "parent")
    dealt = heads.unionByName(after).repartition(n, "bucket").sortWithinPartitions("bucket", "conv", "depth")
    if not rounds:
        return dealt.mapInArrow(_finish, NODE)
    done = cut(dealt.mapInArrow(_finish, NODE), "finished")
    out = [done]
    alone = union(single).select("conv", "len", "level", "parent")
    head = alone.select("conv", "len", "level", "parent", F.col("level").alias("depth"))
    tail = rows.select("conv", "depth").join(alone, "conv").filter("depth > level").select(head.columns)
    last = F.col("depth") == F.col("len")
    out.append(head.unionByName(tail).select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("level"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(NONE)).alias("ends_sha256")))
    hashes = cut(_ends_digest(union([r[3] for r in rounds])), "ends")
    tops = done.select(F.col("conv_id").alias("kid"), F.col("depth").alias("level"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    for info, by_depth, kids, _ in reversed(rounds):  # tops: of all children below that are not alone
        below = kids.join(tops, ["kid", "level"], "left").groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n_kids"), F.sum(F.coalesce("leaves", F.lit(1))).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).alias("saved"))
        chain = by_depth.join(info.select("bucket", "last"), "bucket").filter("depth <= last").select("bucket", "depth", "bytes")
        chain = chain.unionByName(info.select("bucket", F.col("level").alias("depth"), F.col("top_bytes").alias("bytes")))
        own = F.sum((F.col("m") - 1) * F.col("bytes")).over(Window.partitionBy("bucket").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0))
        met = chain.join(info.select("bucket", "level", "parent", "m", "last"), "bucket").join(below, "bucket", "left")
        kids_here = F.coalesce("n_kids", F.lit(0))
        got = met.select(
            F.col("bucket").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("level"), F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"), F.col("m").alias("n_convs"),
            F.when(F.col("depth") < F.col("last"), 1).otherwise(kids_here).cast("long").alias("n_children"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
            (own + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), (F.col("depth") == F.col("level")).alias("is_top"))
        got = cut(got, "chains")
        out.append(got.drop("is_top").join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))))
        tops = tops.unionByName(got.filter("is_top").select(F.col("conv_id").alias("kid"), F.col("depth").alias("level"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    return union([x.select(out[0].columns) for x in out])


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tok) AS nth, tok, strlen(x) AS bytes FROM t),
ids AS (SELECT DISTINCT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1),
    lambda i: [ascii((c::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 9 AS h FROM own),
r AS (SELECT i.c, nth AS d, tok, bytes FROM ids i JOIN own o ON o.c = i.base AND nth <= h
  UNION ALL SELECT i.c, nth - h + least(h, (SELECT count(*) FROM own b WHERE b.c = i.base)), tok, bytes FROM ids i JOIN own o ON o.c = i.c AND nth > h),
p AS (SELECT c, d, bytes, sha256(string_agg(tok, ',') OVER (PARTITION BY c ORDER BY d)) AS node FROM r
  UNION ALL SELECT c, 0, 0, 'root' FROM ids),
len AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT d, node, min(p.c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, string_agg(CASE WHEN d = len THEN p.c::VARCHAR END, ',' ORDER BY p.c) AS ends FROM p JOIN len USING (c) GROUP BY d, node),
up AS (SELECT n.d, n.node, q.node AS parent, q.d AS parent_d FROM n JOIN p q ON q.c = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT parent_d AS d, parent AS node, count(*) AS n_children FROM up GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, node)),
s AS (SELECT q.d, q.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved FROM f JOIN p q ON q.c = f.conv_id AND q.d <= f.d GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS bigint) AS depth, a.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS bigint) AS n_children, CAST(n_leaves AS bigint) AS n_leaves,
  CAST(saved AS bigint) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (d, node) LEFT JOIN up USING (d, node) LEFT JOIN n a ON a.d = up.parent_d AND a.node = up.parent
"""

"""Packing by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left of each goes, longest first, into the
open window with the least room that still holds it, found by a segment tree indexed by remaining capacity. Packing
runs within an input partition, over CHUNK tokens or PIECES_HELD pieces at a time: no shuffle, the same result on a
retry. A worker holds at most 96 MB of known chunks, 4 bytes a held token, a batch of BATCH bytes and one text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import WordBPE
from .common import lean, small_batches, table

WINDOW = 2048
END = 1
#: Tokens of unfinished windows a task holds before it packs and writes them.
CHUNK = 4_000_000
#: Pieces it holds then at most.
PIECES_HELD = 60_000
#: Bytes of texts that are encoded at a time, unless one text is longer.
BATCH = 4 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity; the tree knows which capacities occur."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, window_id: int) -> None:
        self.at[room].append(window_id)
        i = self.size + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window of the least room >= need: (room, id)."""
        i, tree = self.size + need, self.any
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a right neighbour holds a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        out = self.at[room].pop()
        if not self.at[room]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return room, out


def best_fit(lengths: list[int], window: int, first: int = 0) -> tuple[list[tuple[int, int]], int]:
    """(window id, offset) for each length (1 to window), and the next free id; longest first, ties in input order."""
    tree, out, fresh = OpenWindows(window), [(0, 0)] * len(lengths), first
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        if got := tree.tightest(n):
            room, w = got
        else:
            room, w, fresh = window, fresh, fresh + 1
        out[k] = w, window - room
        if room > n:
            tree.put(room - n, w)
    return out, fresh


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, chunk: int = CHUNK) -> DataFrame:
    """Packed pieces: doc_id, start in the document, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null texts are empty: they pack their end id alone. Null ids and repeated rows are packed like others; an empty
    table gives no rows; other columns are not read. Every id is in exactly one piece.
    """
    small_batches(docs.sparkSession, BATCH)
    stop = end.to_bytes(4, "little")

    @lean
    def run(batches):
        tok, seq = WordBPE(tokenizer), TaskContext.get().partitionId() << 40
        rest: list[tuple] = []
        held = 0

        def packed():
            nonlocal seq
            places, seq = best_fit([len(r[2]) // 4 for r in rest], window, seq)
            rows = [(d, s, len(b) // 4, b, n, w, o) for (d, s, b, n), (w, o) in zip(rest, places, strict=True)]
            rest.clear()
            return rows

        def arrow(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            full = []
            for d, ids in zip(b.column("doc_id").to_pylist(), tok.encode(b.column("text").to_pylist()), strict=True):
                ids += stop
                n, at = len(ids) // 4, 0
                while n - at >= window:
                    full.append((d, at, window, ids[4 * at : 4 * (at + window)], n, seq, 0))
                    seq, at = seq + 1, at + window
                if n > at:
                    rest.append((d, at, ids[4 * at :], n))
                    held += n - at
            if full:
                yield arrow(full)
            if held >= chunk or len(rest) >= PIECES_HELD:
                held, rows = 0, packed()
                for i in range(0, len(rows), 1024):
                    yield arrow(rows[i : i + 1024])
        rows = packed()
        for i in range(0, len(rows), 1024):
            yield arrow(rows[i : i + 1024])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """pieces() with a digest for the ids. Null texts pack their end id alone, null ids and repeated rows are packed like
    others, equal lengths go in the order of rows, and an empty table gives no rows."""
    out = pieces(docs, tokenizer or word_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))

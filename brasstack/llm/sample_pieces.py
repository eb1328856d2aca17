"""Segmentations sampled without replacement: Gumbel top-k by a perturbed best-first search.

The model is a piece vocabulary read as a unigram language model: a piece of rank r has log weight
-TEMPER * log(r + 2), which is Zipf's law, a character without a piece is spelt in bytes. A text falls into units no
piece crosses (a run of spaces with what follows it, a line end), so its lattice is a chain of small ones. A set of segmentations has a
Gumbel-perturbed value at its total log probability: the value of its best member. The search starts from the set of
all; it takes the best set, samples the member that holds the value, and splits the others into sets by the first unit
at which they leave it, each with a value drawn below. The k best members come out in order, distinct and exact, with
the probability of inclusion given the next value. Everything is drawn from a generator seeded by the row key.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

SAMPLES = 2
TEMPER = 1.0
SPACE = "▁"
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
KEEP = 300_000
#: Lattices one worker keeps.
LATTICES = 8_000
#: Longer units (in characters) are solved one by one, not in arrays.
LONG = 64
#: New units solved at once.
AT_ONCE = 8192
#: Stands behind a unit's last character.
NO_CHAR = (1 << 21) - 1
OUT = "doc_id long, rank int, log_prob double, value double, inclusion double, ids binary"


class Lattice:
    """Arcs of one unit: to[i] = (end, log weight, ids); below[i] = log total weight of what can follow position i."""

    def __init__(self, unit: str, model: Pieces):
        n, heads, exp = len(unit), model.heads, math.exp
        self.n, self.arcs, self.below = n, [[] for _ in range(n)], [0.0] * (n + 1)
        self.best = [(0.0, 0, b"")] * (n + 1)  # score of the best way on, end of its first piece, that piece's ids
        below, best = self.below, self.best
        for i in range(n - 1, -1, -1):
            arcs = self.arcs[i]
            for j in range(i + 1, n + 1):
                got = heads.get(unit[i:j], 0)
                if got:
                    arcs.append((j, *got))
                elif got == 0:  # no piece begins like this
                    break
            if not arcs or arcs[0][0] != i + 1:
                arcs.insert(0, (i + 1, *model.spelt(unit[i])))
            if len(arcs) == 1:
                j, w, ids = arcs[0]
                below[i] = w + below[j]
                best[i] = w + best[j][0], j, ids
            else:
                top = -math.inf
                for j, w, ids in arcs:  # ties go to the longest piece
                    if w + best[j][0] >= top:
                        top, to, own = w + best[j][0], j, ids
                best[i] = top, to, own
                below[i] = top + math.log(sum([exp(w + below[j] - top) for j, w, _ in arcs]))

    def likeliest(self) -> list[int]:
        """Ends of the pieces of the most probable segmentation."""
        out, i = [], 0
        while i < self.n:
            i = self.best[i][1]
            out.append(i)
        return out

    def best_ids(self) -> bytes:
        """Ids of that segmentation."""
        return b"".join(self.best[i][2] for i in [0, *self.likeliest()[:-1]] if i < self.n)

    def chance(self, i: int, j: int) -> float:
        return next(w + self.below[e] for e, w, _ in self.arcs[i] if e == j) - self.below[i]

    def log_prob(self, path: list[int]) -> float:
        return sum(self.chance(i, j) for i, j in zip([0, *path], path))

    def ids(self, path: list[int]) -> bytes:
        return b"".join(next(b for e, _, b in self.arcs[i] if e == j) for i, j in zip([0, *path], path))

    def finish(self, i: int, rng, without: int = -1) -> list[int]:
        """Samples the ends from position i on; the first is not `without`."""
        out = []
        while i < self.n:
            arcs = [(e, math.exp(w + self.below[e] - self.below[i])) for e, w, _ in self.arcs[i] if out or e != without]
            u = rng.random() * sum(p for _, p in arcs)
            for e, p in arcs:
                u -= p
                if u <= 0:
                    break
            out.append(e)
            i = e
        return out

    def other(self, path: list[int], rng) -> list[int]:
        """Samples a segmentation other than path, exactly: where it leaves path, how, and what follows."""
        ways, before = [], 0.0
        for i, j in zip([0, *path], path):
            q = self.chance(i, j)
            ways.append(math.exp(before) * -math.expm1(q) if len(self.arcs[i]) > 1 else 0.0)
            before += q
        u, t = rng.random() * sum(ways), 0
        for t, p in enumerate(ways):
            u -= p
            if u <= 0 and p:
                break
        start = path[t - 1] if t else 0
        return [*path[:t], *self.finish(start, rng, without=path[t])]


class Lattices:
    """The lattices of many units in arrays, the longest unit first.

    A place is a unit and a level, the number of characters from there to the unit's end. Level k holds a place of each
    unit of k characters or more, in the order of the units, so that what follows a level's places is a slice of another.
    """

    def __init__(self, found: list[str], model: Pieces):
        n = np.array(list(map(len, found)))
        order = np.argsort(-n, kind="stable")
        self.units, self.n = [found[i] for i in order.tolist()], n[order]
        n = self.n
        count = len(n) - np.searchsorted(n[::-1], np.arange(n[0] + 1))
        self.off = off = np.concatenate([[0], np.cumsum(count)])
        size = int(off[-1])
        level = np.repeat(np.arange(n[0] + 1), count)
        chars = np.full(size, NO_CHAR)
        text = np.frombuffer("".join(self.units).encode("utf-32-le", "surrogatepass"), "<u4")
        left = np.repeat(np.cumsum(n), n) - np.arange(len(text))
        chars[off[left] + np.repeat(np.arange(len(n)), n)] = text
        depth = min(model.depth, int(n[0]))
        self.w = w = np.full((depth, size), -np.inf)  # log weight of the piece of d + 1 characters from a place
        self.ids = ids = np.zeros((depth, size), np.uint32)
        at, node = np.arange(len(n), size), np.zeros(size - len(n), np.int64)
        level, pos = level[at], at
        rank = at - off[level]
        for d in range(depth):
            node = model.edges.find(node << 21 | chars[pos])
            hit = np.flatnonzero(node >= 0)
            if not len(hit):
                break
            at, level, rank, node = at[hit], level[hit] - 1, rank[hit], node[hit]
            w[d, at], ids[d, at] = model.weight[node], model.id[node]
            pos = off[level] + rank
        bare = np.flatnonzero(np.isneginf(w[0, len(n) :])) + len(n)
        w[0, bare] = model.far  # spelt in bytes; such units are solved one by one
        self.spelt = np.zeros(len(n), bool)
        self.spelt[bare - off[np.searchsorted(off, bare, "right") - 1]] = True
        self.below, self.best, self.step = below, best, step = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        both = np.empty((depth, len(n)))
        for k in range(1, int(n[0]) + 1):
            a, b, c = off[k], off[k + 1], count[k]
            s, ways = both[: min(k, depth), :c], range(min(k, depth))
            for d in ways:
                np.add(w[d, a:b], below[off[k - d - 1] : off[k - d - 1] + c], out=s[d])
            top = s.max(0)
            below[a:b] = top + np.log(np.exp(s - top).sum(0))
            for d in ways:
                np.add(w[d, a:b], best[off[k - d - 1] : off[k - d - 1] + c], out=s[d])
            step[a:b] = j = len(ways) - 1 - s[::-1].argmax(0)  # ties go to the longest piece
            best[a:b] = s[j, np.arange(c)]

    def likeliest(self) -> tuple[np.ndarray, list[bytes]]:
        """Log probabilities of the units' most probable segmentations, and their ids."""
        first = self.off[self.n] + np.arange(len(self.n))
        left, who, ids, owner = self.n, np.arange(len(self.n)), [], []
        while len(left):
            cur = self.off[left] + who
            d = self.step[cur]
            ids.append(self.ids[d, cur])
            owner.append(who)
            left = left - d - 1
            on = left > 0
            left, who = left[on], who[on]
        return np.minimum(0.0, self.best[first] - self.below[first]), _dealt(ids, owner, len(self.n))

    def others(self, which: np.ndarray, u: np.ndarray) -> list[tuple | None]:
        """(ends, ids, log probability) of a segmentation of each of the units other than the likeliest, from a uniform
        number each, by inverting the distribution piece by piece; None where rounding leaves no other way."""
        left, who, row, on = self.n[which], which, np.arange(len(which)), np.ones(len(which), bool)
        lp, same = -self.below[self.off[left] + who], np.zeros(len(which), bool)
        ids, ends, owner = [], [], []
        ahead = np.arange(1, len(self.w) + 1)[:, None]
        while len(left):
            cur, here = self.off[left] + who, np.arange(len(left))
            own = self.w[:, cur]
            p = np.exp(own + self.below[self.off[np.maximum(left - ahead, 0)] + who] - self.below[cur])
            d = self.step[cur]
            p[d, here] = np.maximum(0.0, p[d, here] - np.where(on, np.exp(self.best[cur] - self.below[cur]), 0.0))
            upto = np.cumsum(p, 0)
            x = u * upto[-1]
            some = upto[-1] > 0
            c = np.where(some, (upto > x).argmax(0), d)
            p = p[c, here]
            u = np.clip((x - upto[c, here] + p) / np.where(some, p, 1.0), 0.0, 1.0 - 2.0**-53)
            on = on & (c == d)
            lp[row] += own[c, here]
            left = left - c - 1
            ids.append(self.ids[c, cur])
            ends.append(self.n[who] - left)
            owner.append(row)
            same[row[on & (left == 0)]] = True
            go = left > 0
            left, who, row, on, u = left[go], who[go], row[go], on[go], u[go]
        out = zip(_dealt(ends, owner, len(which)), _dealt(ids, owner, len(which)), lp.tolist(), same.tolist())
        return [None if bad else (e, i, p) for e, i, p, bad in out]


def _dealt(values: list[np.ndarray], owner: list[np.ndarray], n: int) -> list[bytes]:
    """Each owner's values in a row, as little-endian unsigned 32-bit numbers."""
    who = np.concatenate(owner)
    raw = np.concatenate(values)[np.argsort(who, kind="stable")].astype("<u4").tobytes()
    cuts = [0, *(4 * np.cumsum(np.bincount(who, minlength=n))).tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


class Edges:
    """A hash table of numbers of 0 or more, each slot's next one being tried where it is taken; at least 3 of 4 slots stay free."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1), np.full(1 << bits, -1)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], slot[~own] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 for others."""
        slot = self._slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.values[slot], -1)
        go = np.flatnonzero((met != keys) & (met >= 0))
        while len(go):
            slot[go] = slot[go] + 1 & self.last
            met = self.keys[slot[go]]
            out[go] = np.where(met == keys[go], self.values[slot[go]], -1)
            go = go[(met != keys[go]) & (met >= 0)]
        return out


class Pieces:
    """A vocabulary as a unigram model, and what is known of the units met so far."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.text = {}, [0] * 256, {}
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.pieces[p] = -TEMPER * math.log(i + 2.0), i.to_bytes(4, "little")
                self.text[i] = p.replace(SPACE, " ").encode()
        self.heads = {p[:n]: None for p in self.pieces for n in range(1, len(p))} | self.pieces
        self.far = -TEMPER * math.log(sp.vocab_size() + 2.0)
        self.known: dict[str, int] = {}  # unit -> its place in the two lists below
        self.lps: list[float] = []
        self.raw: list[bytes] = []
        self.lattices: dict[str, Lattice] = {}
        prefixes = ["", *self.heads]
        node = {p: i for i, p in enumerate(prefixes)}
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in prefixes[1:]], np.int64)
        # edges of the trie: parent and character, child; what a node weighs as a piece, and its id
        self.edges = Edges(keys, np.arange(1, len(prefixes)))
        self.weight = np.array([-np.inf, *(v[0] if v else -np.inf for v in self.heads.values())])
        self.id = np.array([0, *(int.from_bytes(v[1], "little") if v else 0 for v in self.heads.values())], np.uint32)
        self.depth = max(map(len, self.pieces))

    def lattice(self, unit: str) -> Lattice:
        got = self.lattices.get(unit)
        if got is None:
            if len(self.lattices) >= LATTICES:
                self.lattices.clear()
            got = Lattice(unit, self)
            if len(unit) <= LONG:
                self.lattices[unit] = got
        return got

    def meet(self, parts: list[list[str]]) -> None:
        """Makes the units of texts known; what was known is forgotten first if it would be too much."""
        here = set().union(*parts)
        new = here.difference(self.known)
        if len(self.lps) + len(new) > KEEP:
            self.known, self.lps, self.raw, new = {}, [], [], here
        self.long = single = [u for u in new if len(u) > LONG]
        found = list(new.difference(single))
        for i in range(0, len(found), AT_ONCE):
            some = Lattices(found[i : i + AT_ONCE], self)
            lps, ids = some.likeliest()
            self.known.update(zip(some.units, range(len(self.lps), len(self.lps) + len(ids))))
            self.lps += lps.tolist()
            self.raw += ids
            single = single + [some.units[i] for i in np.flatnonzero(some.spelt)]
        for u in single:
            lat = self.lattice(u)
            self.known[u] = len(self.lps)
            self.lps.append(min(0.0, lat.best[0][0] - lat.below[0]))
            self.raw.append(lat.best_ids())

    def forget(self) -> None:
        """Long units aren't kept from batch to batch."""
        for u in self.long:
            del self.known[u]

    def others(self, wanted: list[str], u: list[float]) -> list[tuple]:
        """(ends, ids, log probability) of a segmentation other than the likeliest of each unit, drawn by a uniform number each."""
        out: list[tuple | None] = [None] * len(wanted)
        for a in range(0, len(wanted), AT_ONCE):
            here = range(a, min(a + AT_ONCE, len(wanted)))
            short = {wanted[i] for i in here if len(wanted[i]) <= LONG}
            if short:
                some = Lattices(list(short), self)
                place = {x: i for i, (x, one) in enumerate(zip(some.units, some.spelt.tolist())) if not one}
                rows = [i for i in here if wanted[i] in place]
                if rows:
                    got = some.others(np.array([place[wanted[i]] for i in rows]), np.array([u[i] for i in rows]))
                    for i, x in zip(rows, got):
                        out[i] = x
            for i in here:
                if out[i] is None:
                    lat = self.lattice(wanted[i])
                    path = lat.other(lat.likeliest(), np.random.default_rng(int(u[i] * 2.0**53)))
                    out[i] = np.array(path, "<u4").tobytes(), lat.ids(path), lat.log_prob(path)
        return out

    def spelt(self, char: str) -> tuple[float, bytes]:
        raw = char.encode("utf-8", "surrogatepass")
        return self.far * len(raw), b"".join(self.bytes[b].to_bytes(4, "little") for b in raw)

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space put before the first word is taken away."""
        raw = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


def units(text: str) -> list[str]:
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class _Path:
    """A whole text's segmentation: the best ids of each unit but where it differs, diff: {unit: (ends, ids, log prob)}.
    It is drawn from unit `start` on, and equals `before` in front of that but for what unit start - 1 has of its `own`."""

    def __init__(self, base: np.ndarray, start: int, rng, before=None, own=None):
        self.logs = base.copy()
        self.diff = {}
        if before is not None:
            self.diff = {i: v for i, v in before.diff.items() if i < start - 1} | {start - 1: own}
            self.logs[: start - 1] = before.logs[: start - 1]
            self.logs[start - 1] = own[2]
        likely = np.exp(self.logs[start:])
        self.leave = (start + np.flatnonzero(rng.random(len(base) - start) >= likely)).tolist()
        self.drawn = rng.random(len(self.leave)).tolist()

    def complete(self, got: list[tuple]) -> None:
        self.diff.update(zip(self.leave, got))
        self.logs[self.leave] = [x[2] for x in got]


def _search(parts: list[str], key, k: int, model: Pieces):
    """A generator of (units, uniform numbers); takes what model.others() makes of them, and returns the rows of top_k."""
    if not parts:
        return [(0.0, 0.0, 1.0, b"")]
    rng = np.random.default_rng(xxhash.xxh64_intdigest(str(key).encode()))
    known = list(map(model.known.__getitem__, parts))
    base = np.array(list(map(model.lps.__getitem__, known)))
    likely = list(map(model.raw.__getitem__, known))
    count = itertools.count()

    def wanted(p: _Path):
        return [parts[i] for i in p.leave], p.drawn

    def way(p: _Path, i: int) -> list[int]:
        return np.frombuffer(p.diff[i][0], "<u4").tolist() if i in p.diff else model.lattice(parts[i]).likeliest()

    def sets(p: _Path, value: float, first: int):
        """The sets that leave p at unit first or later, only the best k + 1 of them: each holds one member at its value."""
        before = np.concatenate([[0.0], np.cumsum(p.logs)[:-1]])[first:]
        with np.errstate(divide="ignore"):
            mass = np.log(-np.expm1(np.minimum(p.logs[first:], 0.0))) + before
        drawn = -np.logaddexp(-value, np.log(rng.exponential(size=len(mass))) - mass)
        drawn[~np.isfinite(mass)] = -np.inf
        best = np.argpartition(-drawn, k)[: k + 1] if len(drawn) > k + 1 else range(len(drawn))
        return [(float(-drawn[i]), next(count), p, first + int(i), None) for i in best if drawn[i] > -np.inf]

    value = float(rng.gumbel())
    p = _Path(base, 0, rng)
    p.complete((yield wanted(p)))
    found = [(value, p)]
    queue = sets(p, value, 0)
    heapq.heapify(queue)
    while queue and len(found) < k:
        value, _, old, at, taken = heapq.heappop(queue)
        value = -value
        lat = model.lattice(parts[at])
        taken = taken or [way(old, at)]
        path = lat.other(taken[0], rng)
        while path in taken:
            path = lat.other(taken[0], rng)
        p = _Path(base, at + 1, rng, old, (np.array(path, "<u4").tobytes(), lat.ids(path), lat.log_prob(path)))
        p.complete((yield wanted(p)))
        found.append((value, p))
        taken = [*taken, path]
        left = 1.0 - sum(math.exp(lat.log_prob(t)) for t in taken)
        if left > 1e-12:  # members that leave at the same unit but take none of these ways
            mass = math.log(left) + float(p.logs[:at].sum())
            drawn = -float(np.logaddexp(-value, math.log(rng.exponential()) - mass))
            heapq.heappush(queue, (-drawn, next(count), p, at, taken))
        for s in sets(p, value, at + 1):
            heapq.heappush(queue, s)
    nxt = -queue[0][0] if queue else -math.inf
    out = []
    for value, p in found:
        own = likely.copy()
        for i, x in p.diff.items():
            own[i] = x[1]
        lp = float(p.logs.sum())
        out.append((lp, value, float(-math.expm1(-math.exp(min(700.0, lp - nxt)))) if nxt > -math.inf else 1.0, b"".join(own)))
    return out


def top_ks(texts: list[str | None], keys: list, k: int, model: Pieces) -> list[list[tuple]]:
    """top_k of each text with its key; the searches run in step, so that their draws are made together."""
    parts = [units(t or "") for t in texts]
    model.meet(parts)
    out: list = [None] * len(texts)
    turn = [(i, _search(p, key, k, model), None) for i, (p, key) in enumerate(zip(parts, keys, strict=True))]
    while turn:
        asked = []
        for i, search, got in turn:
            try:
                asked.append((i, search, search.send(got)))
            except StopIteration as end:
                out[i] = end.value
        ways = iter(model.others([x for _, _, (us, _) in asked for x in us], [x for _, _, (_, u) in asked for x in u]))
        turn = [(i, search, list(itertools.islice(ways, len(us)))) for i, search, (us, _) in asked]
    model.forget()
    return out


def top_k(text: str | None, key, k: int, model: Pieces) -> list[tuple[float, float, float, bytes]]:
    """(log probability, perturbed value, inclusion probability, ids) of k distinct segmentations, best value first; fewer if there are fewer."""
    return top_ks([text], [key], k, model)[0]


def sampled(docs: DataFrame, model: str, k: int = SAMPLES, key: str = "doc_id") -> DataFrame:
    """doc_id, rank (from 0), log_prob, value, inclusion, ids (little-endian unsigned 32-bit) of k segmentations a row.

    A null or empty text has one segmentation, without ids. Rows are seeded by their key: a null key is a key like any
    other, repeated rows are sampled alike. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        m = Pieces(model)
        gc.collect()
        gc.freeze()  # the vocabulary stays; what is made after it has hardly any cycles
        gc.set_threshold(200_000, 20, 100)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = top_ks(part.column("text").to_pylist(), part.column("key").to_pylist(), k, m)
                rows = [(d, r, *x) for d, own in zip(part.column("doc_id").to_pylist(), got) for r, x in enumerate(own)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "rank", "log_prob", "value", "inclusion", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(key).cast("string").alias("key"), F.col("text").cast("string")).mapInArrow(run, OUT)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """rows with ids turned back into text."""

    def run(batches):
        m = Pieces(model)
        for b in batches:
            i = b.schema.get_field_index("ids")
            t = pa.array([m.decode(x or b"") for x in b.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([t if j == i else b.column(j) for j in range(b.num_columns)], names=["text" if j == i else n for j, n in enumerate(b.schema.names)])

    return rows.mapInArrow(run, ", ".join(f"`{'text' if f.name == 'ids' else f.name}` {'string' if f.name == 'ids' else f.dataType.simpleString()}" for f in rows.schema))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sample_pieces(spark, sf_dir: str) -> DataFrame:
    out = sampled(table(spark, sf_dir, "documents"), piece_model())
    return out.select("doc_id", "rank", "log_prob", "value", "inclusion", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"))

"""Fingerprints, the filter audit and the conversation trie against brute-force versions."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from brasstack.llm import conversation_trie, filter_audit, order_minhash

SCHEMA = "doc_id long, text string, source string, position long, sig string, n long, words int, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed64(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*values):
    """xxhash64 of strings, longs (ints) and ints (in a tuple), as Spark chains them."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, seed=h & (2**64 - 1))
    return signed64(h)


def signature(text):
    m = order_minhash
    seen, points = Counter(), []
    for i in range(len(text)):
        if i == 0 or not re.match("[A-Za-tv-z]", text[i - 1]) or text[i - 1] in "uU":
            h = hash_of(text[i : i + m.K]) >> m.PLACE
            points.append((hash_of(h, (seen[h],)) >> m.PLACE, len(points)))
            seen[h] += 1
    if not points:
        return [0] * m.REPS
    out, step = [], 1 << (64 - m.PLACE - 7)
    for j in range(m.REPS):
        anchor = (j - m.REPS // 2) * step
        two = sorted(points, key=lambda p: (p[0] < anchor, p))[:2]
        two = sorted(two if len(two) == 2 else two * 2, key=lambda p: p[1])
        out.append((hash_of(two[0][0], two[1][0]) & (2**64 - 1)) >> 48)
    return out


def texts():
    rng = random.Random(5)
    words = ["rope", "tin", "Wheel", "of", "the", "und", "é", "lever,", "sun.", "12a", "it's", "漢字", "𝄞𝄞", "you"]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]
    return out + out[:6] + ["", None, " \n ", "a", "ab" * 400, "u" * 300, "word " * 3000, "漢字かな" * 50, "\U0001d11e" * 40, "f", "AB#CD", "A 1", "a\x0bb\x0cc"]


def test_order_minhash(spark):
    rows = [(3 * i, t) for i, t in enumerate(texts())] + [(9, texts()[3]), (9, texts()[3]), (9, "other text of id nine"), (None, "null id"), (None, texts()[1]), (None, "null id")]
    docs = spark.createDataFrame([(d, t, "s", 1, "x", 2, 3, "y") for d, t in rows], SCHEMA).repartition(5)
    got = order_minhash.fingerprints(docs).collect()
    line = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hash_of(r[1] or "")))
    want = []
    for k, (d, t) in enumerate(line):
        t, nxt = t or "", line[(k + 1) % len(line)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, e, b = signature(t), signature(edited), signature(nxt)
        like = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / 128
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:04x}" for x in a), "".join(f"{x:04x}" for x in e), like(a, e), like(a, b)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    plan = order_minhash.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert order_minhash.fingerprints(docs.limit(0)).count() == 0
    alone = order_minhash.fingerprints(docs.filter("doc_id = 0")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


def test_order_minhash_follows_edit_distance(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("be", "ta", "mo", "si", "ru") for b in ("ka", "lo", "mi", "ne", "po", "du")]
    base = rng.choices(words, k=300)
    few, many, moved = base[:], base[:], base[150:] + base[:150]
    for i in rng.sample(range(300), 6):
        few[i] = "changed"
    for i in rng.sample(range(300), 90):
        many[i] = "changed"
    shuffled = rng.sample(base, 300)
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((base, few, many, moved, shuffled))], "i int, text string")
    sig = {r["i"]: r["sig"] for r in order_minhash.signed(frame, "text", "sig").collect()}
    near = [sum(a == b for a, b in zip(sig[0], sig[i], strict=True)) / 128 for i in range(5)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[4] and near[1] > near[3] > near[4] and near[1] > 0.5


def test_filter_audit(spark):
    rng = random.Random(8)
    base = [*texts(), *(" ".join(f"w{rng.randint(0, 400)}" for _ in range(250)) for _ in range(30)), "same " * 250, "# " + "same " * 250]
    rows = [(i, t, rng.choice(("a", "b", "", None))) for i, t in enumerate(base + base[::3])] + [(None, "x", "a"), (None, "x", "b"), (None, base[0], "a"), (2, base[2], "a"), (2, base[2], "a")]
    docs = spark.createDataFrame([(d, t, s, 1, "x", 2, 3, "y") for d, t, s in rows], SCHEMA).repartition(4)
    label_rows = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int")
    good, toxic = {d for d, q, _ in label_rows if q == 1 and d is not None}, {d for d, _, x in label_rows if x == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        least[t or ""] = min(least.get(t or "", 2**63 - 1), 2**63 - 1 if d is None else d)
    parts = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), (2**63 - 1 if d is None else d) > least[t]), strict=True) if bad]
        parts[s or ""].append((d, set(fails)))
    want, removed_by = {}, Counter()
    for part, members in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                fails = sum(f in m[1] for m in members)
                want[part, order, step] = (len(left), len(gone), fails - len(gone), sum(m[1] == {f} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone))
                removed_by[part, f] += len(gone)
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == len(want) == 600 * len(parts)
    for r in got:
        k = r["part"], r["filter_order"], r["step"]
        assert tuple(r)[3:] == (*want[k], removed_by[k[0], k[1][k[2] - 1]]), k
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert all(r["good_lost"] == 0 for r in filter_audit.audit(docs, labels.limit(0)).collect())


def brute_trie(rows):
    own = defaultdict(list)
    tok = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, tok(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].add(c)
    kids, leaves, saved = defaultdict(int), Counter(), Counter()
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    line = lambda: (rng.choice(("user", "assistant", None)), rng.choice(("yes", "no", "é" * 5, None, "more")))
    rows = [(c, t, *line()) for c in range(-7, 60) if c % 7 for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"shared {t}" if t < 12 else f"own {t} {c % 3}") for c in range(100, 140) for t in range(30)]  # long common paths, copies
    rows += [(200 + c, t, "user", "same first") for c in range(40) for t in range(c % 4 + 1)]
    return rows + [(300, None, "user", "null turn"), (300, None, None, None), (300, 0, "user", "tie"), (300, 0, "assistant", "tie"), (300, 0, "user", "tie"), (None, 1, "user", "no id"), (400, 0, "user", "x" * 100_000)]


@pytest.mark.parametrize("local", [1, 25, 10_000])
def test_conversation_trie(spark, talks, local):
    frame = spark.createDataFrame([(*r, 1, 2) for r in talks], "conv_id long, turn long, role string, text string, conv long, depth long").repartition(3)
    got = conversation_trie.trie(frame, local).collect()
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute_trie(talks), key=key)


def test_conversation_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie(none).count() == 0
    one = spark.createDataFrame([(3, 0, "user", "a")], none.schema)
    assert sorted(map(tuple, conversation_trie.trie(one).collect())) == brute_trie([(3, 0, "user", "a")])
    ends = spark.createDataFrame([(1, 2, c) for c in range(-50, 70_000, 3)] + [(5, 0, 8)], "conv_id long, depth long, conv long").repartition(3)
    got = {r["conv_id"]: r["ends_sha256"] for r in conversation_trie._ends_digest(ends).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(-50, 70_000, 3))).encode()).hexdigest(), 5: hashlib.sha256(b"8").hexdigest()}

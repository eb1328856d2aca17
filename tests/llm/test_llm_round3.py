"""Findings of the third round, each with a case that failed before."""

import random
import struct
from collections import Counter

import pytest
import xxhash

from brasstack.llm import order_minhash, registry, sample_pieces


def signed64(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*values):
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, seed=h & (2**64 - 1))
    return signed64(h)


def signature(text):
    """Of the k-mers from every code point on."""
    m = order_minhash
    seen, points = Counter(), []
    for i in range(len(text)):
        h = hash_of(text[i : i + m.K]) >> m.PLACE
        points.append((hash_of(h, (seen[h],)) >> m.PLACE, i))
        seen[h] += 1
    out, step = [], 1 << (64 - m.PLACE - 7)
    for j in range(m.REPS if points else 0):
        anchor = (j - m.REPS // 2) * step
        two = sorted(sorted(points, key=lambda p: (p[0] < anchor, p))[:2] * (2 if len(points) == 1 else 1), key=lambda p: p[1])
        out.append((hash_of(two[0][0], two[1][0]) & (2**64 - 1)) >> 48)
    return out or [0] * m.REPS


@pytest.mark.parametrize("near", [order_minhash.NEAR, 1])
def test_order_minhash_of_every_position(spark, tmp_path, monkeypatch, near):
    monkeypatch.setattr(order_minhash, "NEAR", near)  # 1: bins are left with fewer than two points, so all are sorted
    rng = random.Random(6)
    words = ["rope", "tin", "Wheel", "und", "é", "lever,", "漢字", "𝄞𝄞", "constitutionally", "\n"]
    texts = ["a" * 9 + "x" * 90, "a" * 9 + "y" * 90, "unbrokenrunofletters" * 20, "", None, "ab", "𝄞", "ab" * 3000, " ".join(rng.choices(words, k=1500)), " ".join(rng.choices(words, k=150))]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["fingerprint"] for r in registry.QUERIES["op11_order_minhash"](spark, str(tmp_path)).collect()}
    assert got == {i: "".join(f"{x:04x}" for x in signature(t or "")) for i, t in rows}
    assert got[0] != got[1]


def test_samples_leave_the_likeliest_way():
    m = sample_pieces.Pieces(sample_pieces.piece_model())
    text = " ".join(("international understanding of unbelievable tokenizations, reinvestigated thoughtfully by grandmothers",) * 20)
    best = b"".join(m.lattice(u).best_ids() for u in sample_pieces.units(text))
    runs = sample_pieces.top_ks([text] * 100, list(range(100)), 2, m)
    assert len({x[3] for r in runs for x in r}) == 200 and not any(x[3] == best for r in runs for x in r)
    m.meet([sample_pieces.units(text)])
    log_prob = sum(m.lps[m.known[u]] for u in sample_pieces.units(text))
    assert log_prob < -5  # with weights raised to the sixth power the likeliest way had nearly all mass

"""Each operator against a brute-force version, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zlib
from pyspark.sql import functions as F

from brasstack.llm import chunks, exact_dedup, line_dedup, packing, quality_model, quality_rules, sample_pieces, secrets, simhash, token_counts, toxicity, weak

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    words = ["rope", "tin", "Wheel", "of", "the", "and", "é", "lever,", "sun.", "12a", "it's"]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(40)]
    out += out[:6] + [out[0].replace(" ", "\t \n")] + ["", None, " \n ", "a", "x" * 5000, "word " * 3000]
    out += ["\n".join(["shared line of some words here", f"own {i} number of the text"]) for i in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 7, True) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "null id", None, None, None, None, None), (None, texts()[1], None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    first = {hashlib.sha256(t.encode()).hexdigest(): (min((d for d in g if d is not None), default=None), len(g)) for t, g in groups.items()}
    assert all((r["keep_id"], r["group_size"]) == first[r["text_sha256"]] for r in got)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and sorted(norm(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0


def test_exact_dedup_over_many_batches(spark):
    rng = random.Random(9)
    rows = [(i, f"text {rng.randint(0, 900)}", None, None, None, None, None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(20)
    first, n = {}, Counter(r[1] for r in rows)
    for r in rows:
        first.setdefault(r[1], r[0])
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        got = exact_dedup.exact_dedup(docs).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, first[t], n[t], first[t] == i) for i, t, *_ in rows}
        assert sorted(r["doc_id"] for r in exact_dedup.drop_exact(docs).collect()) == sorted(first.values())
    finally:
        spark.conf.set(key, old)


def brute_fingerprint(text):
    ws = [bytes(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))]
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    root = {v: v for v in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {v: find(v) for v in fps}


def near_groups(rows):
    """Component of each row's fingerprint, by its place among the distinct ones."""
    distinct = sorted({f for _, f in rows})
    return {distinct[v]: root for v, root in components(dict(enumerate(distinct))).items()}


def test_simhash(docs, none):
    got = simhash.near_dedup(docs).collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    group, low = near_groups(rows), {}
    for d, f in rows:
        low[group[f]] = min([x for x in (low.get(group[f]), d) if x is not None], default=None)
    key = lambda x: tuple((y is None, y) for y in x)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(((d, f"{f:016x}", low[group[f]]) for d, f in rows), key=key)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    stay = [(r["doc_id"], group[brute_fingerprint(r["text"])]) for r in kept.collect()]
    assert sorted(g for _, g in stay) == sorted(low) and all(d == low[g] for d, g in stay)
    assert simhash.near_dedup(none).count() == 0 and simhash.drop_near(none).count() == 0


def test_rows_without_ids_join_no_groups(spark):
    base = [random.Random(i).choices([f"w{k}" for k in range(400)], k=300) for i in range(4)]
    texts = [" ".join(b) for b in base] + [" ".join([*base[0][:-1], "other"]), " ".join([*base[3][:-1], "other"])]
    fps = [brute_fingerprint(t) for t in texts]
    ids = [None, None, 7, 3, None, 9]
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in zip(ids, texts)], SCHEMA)
    got = {r["fingerprint"]: r["component_id"] for r in simhash.near_dedup(d).collect()}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2
    assert got[f"{fps[0]:016x}"] is None and got[f"{fps[1]:016x}"] is None and got[f"{fps[2]:016x}"] == 7
    assert got[f"{fps[5]:016x}"] == (3 if near(3, 5) else 9)
    assert simhash.drop_near(d).count() == 6 - near(0, 4) - near(3, 5)


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "same text here", "a", "x"), (2, "same  text here", "b", "y"), (None, "same text here", "c", "z"), (1, "same text here", "a", "x"), (4, "another one", "d", "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, _sha string")
    for x in ("_row", "_key", "_text", "row", "fp", "v", "sha"):
        d = d.withColumn(x, F.concat("_id", F.lit(x)))
    want = sorted(tuple(r) for r in d.filter("doc_id IN (1, 4)").distinct().collect())
    for f in (exact_dedup.drop_exact, simhash.drop_near):
        out = f(d)
        assert out.columns == d.columns and sorted(tuple(r) for r in out.collect()) == want
    assert quality_rules.keep_good(d, d.select("doc_id")).columns == d.columns and secrets.redacted(d).collect() == d.collect()


def test_simhash_links_are_complete(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:  # chains and clusters far larger than a group
        for _ in range(60):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    fps = dict(enumerate(sorted(fps, key=simhash._signed)))
    monkeypatch.setattr(simhash, "GROUP", 8)
    monkeypatch.setattr(simhash, "TILE", 3)
    v = spark.createDataFrame([(simhash._signed(f),) for f in fps.values()], "fp long")
    roots = {r["v"]: r["root"] for r in simhash.components(simhash.links(v)).collect()}
    at = {simhash._signed(f): i for i, f in fps.items()}
    assert {i: at[roots.get(f, f)] for f, i in at.items()} == components(fps)


def test_quality_rules(spark, docs, none):
    good = spark.createDataFrame([(i,) for i in range(0, 30, 2)] + [(None,)], "doc_id long")
    got = quality_rules.quality_rules(docs, good)
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    for r in docs.collect():
        if r["doc_id"] is None:
            continue
        t = r["text"] or ""
        w = WORD.findall(t)
        g = list(zip(w, w[1:], w[2:]))
        c, pos = Counter(g), set()
        for i, x in enumerate(g):
            pos |= {i, i + 1, i + 2} if c[x] > 1 else set()
        ls = [x for x in t.split("\n") if WORD.search(x)]
        q = by[r["doc_id"]]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(ls) - len(set(ls)), len(pos))
        assert q["base_failed"] == (len(w) < 50 or 100 * len(pos) > 50 * len(w)) and not (q["kept"] and q["base_failed"])
    assert quality_rules.quality_rules(none, good).count() == 0
    kept = quality_rules.keep_good(docs, good)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()


def brute_grams(t):
    """Buckets of a text's words and word pairs: XXH64 with seed 42, as the engine's built-in hash gives it."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(t or "")]
    mask = quality_rules.BUCKETS - 1
    return [x & mask for x in h] + [(a ^ (b << 1)) & mask for a, b in zip(h, h[1:])]


def brute_scores(rows, good):
    raw, trusted, total = Counter(), Counter(), 0.0
    kind = defaultdict(bool)
    for d, t in rows:
        kind[t or ""] |= d is not None and d in good
    for t, g in kind.items():
        raw.update(brute_grams(t))
        if g:
            trusted.update(brute_grams(t))
    n, m, p = sum(raw.values()), sum(trusted.values()), quality_rules.PRIOR

    def weight(b):
        others = max(raw[b] - 1, trusted[b])
        times = trusted[b] / m / (others / n) if others else 1.0
        return round(1000 * (1 + p) * np.log((times + p) / (1 + p)))

    return {(d, t): sum(map(weight, brute_grams(t))) / max(1, len(brute_grams(t))) if m else 0.0 for d, t in rows}


def test_quality_scores_equal_brute_force(docs):
    good = {i for i in range(0, 30, 2)}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_scores(rows, good)
    got = quality_rules.measured(docs.select("doc_id", "text"), quality_rules.ratios(docs, docs.sparkSession.createDataFrame([(i,) for i in good] + [(None,)], "doc_id long"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"], r["text"]], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)


def test_copies_change_no_verdict(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=80))) for i in range(120)]
    good = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    seen = []
    for n, bound in ((1, 500_000), (100, 500_000), (100, 0), (3_000, 500_000)):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", bound)
        more = [(1000 + i, rows[110][1]) for i in range(n)] + [(None, rows[3][1])] * (n // 2)
        d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows + more], SCHEMA).repartition(5)
        seen.append({(r["doc_id"], r["score"], r["kept"]) for r in quality_rules.quality_rules(d, good).collect() if r["doc_id"] is not None and r["doc_id"] < 1000})
    assert len(seen[0]) == 120 and seen[0] == seen[1] == seen[2] == seen[3]


def test_ratio_prefers_trusted_text(spark):
    rows = [(i, " ".join(random.Random(i).choices(["good", "fine", "text", "here"], k=80)), None, None, None, None, None) for i in range(30)]
    rows += [(100 + i, " ".join(random.Random(i).choices(["@@", "##", "!!", "$$"], k=80)), None, None, None, None, None) for i in range(30)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["score"] for r in quality_rules.quality_rules(d, spark.createDataFrame([(i,) for i in range(15)], "doc_id long")).collect()}
    assert min(got[i] for i in range(30)) > max(got[100 + i] for i in range(30))


def test_quality_words_keep_their_ends(spark):
    own = ["f", "f for if of", "for if", "fff ab f", "\fab cd\f", "\f", "of the leaf\f\f", "f ab cd f ab cd f", "if ab cd x if ab cd f"]
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(own)], SCHEMA)
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality_rules.quality_rules(d, d.select("doc_id")).collect()}
    for i, t in enumerate(own):
        w = WORD.findall(t)
        g = list(zip(w, w[1:], w[2:]))
        assert got[i] == (len(w), len({k + j for k, x in enumerate(g) if g.count(x) > 1 for j in range(3)}))


@pytest.mark.parametrize("n", [60, 600, 3000])
def test_junk_is_judged_alike_at_any_size(spark, n):
    rng = random.Random(n)
    words, junk = [f"w{i}" for i in range(300)], [f"j{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=90) + rng.choices(junk if i % 12 == 0 else words, k=30)), None, None, None, None, None) for i in range(n)]
    d = spark.createDataFrame(rows, SCHEMA)
    good = spark.createDataFrame([(i,) for i in range(n) if i % 12 and i % 3], "doc_id long")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(d, good).filter("kept").collect()}
    assert not {i for i in kept if i % 12 == 0} and len(kept) >= 0.98 * sum(i % 12 > 0 for i in range(n))


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


SECRET_TEXTS = ["password=abcdefgh1", "PassWord: short token = 'longenough99'", "password: secret: abcdefghijk", "toKen=abcdefghij ſecret=abcdefghij", "AKIA" + "A" * 12 + " AKIAB", "x" + "0a" * 16 + "g", "api_key=" + "f" * 40, "é password=äabcdefghijk", "", None]


def test_secrets(spark, none):
    for t in SECRET_TEXTS:
        assert [(a, k, b) for a, k, b, *_ in secrets.find(t) if k < 3] == base_spans(t or "")
    code = 'key_material = "Zx81kQ0pLm77Rt2v"\nname = "plain words"\ndb_password = key_material\nurl = "http://x"\n{"client_secret": "aB3dE5gH7jK9mN1p"}\npassword = "changeme"'
    found = [code[a:b] for a, k, b, *_ in secrets.find(code) if k == 3]
    assert found == ["Zx81kQ0pLm77Rt2v", "aB3dE5gH7jK9mN1p"]
    assert "Zx81" not in secrets.redact(code) and "plain words" in secrets.redact(code)
    d = spark.createDataFrame([(i, t, None, None, 1, None, None) for i, t in enumerate(SECRET_TEXTS)], SCHEMA)
    out = secrets.redacted(d)
    assert out.columns == d.columns and all(not base_spans(r["text"] or "") for r in out.collect())
    assert secrets.secret_spans(none).count() == 0 and secrets.secret_spans(d).count() == len(SECRET_TEXTS)


ODD = ["Ábc. J̌ x", "don't Foo's,!! <|endoftext|> a<|startoftext|>b", "ΑΣ Σ. İx y\x1cz 12a3,4.", "a\tb\x0bc  \r\n", "", None, "Å. ŉ x…y— w.!? Of%%% A's", "  lead x   y\n\n z", "Straße ÉTÉ"]


def test_tokens_equal_whole_texts():
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    path = packing.word_tokenizer()
    whole, mine = Tokenizer.from_file(path), chunks.WordBPE(path, keep=20_000)
    for t, b in zip(ODD + texts(), mine.encode(ODD + texts()), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids
    file = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}, special_tokens={})
    assert chunks.ByteBPE(file, P.PATTERN).counts(ODD + texts()) == [len(enc.encode_ordinary(t or "")) for t in ODD + texts()]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_tokenizer())
    rows = packing.pieces(docs, packing.word_tokenizer(), window=64, chunk=500).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["ids"]))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    for d, g in itertools.groupby(sorted(((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in (None, 3))), key=lambda x: x[0]):
        ids = tok.encode(next(g)[1] or "", add_special_tokens=False).ids + [1]
        assert b"".join(b for _, b in sorted(by_doc[d])) == np.array(ids, "<u4").tobytes()
    total = sum(n for p in by_seq.values() for _, n in p)
    assert len(by_seq) <= total / 64 * 1.1 + 12
    digest = packing.packed(docs).first()
    assert 0 <= digest["ids_crc32"] < 1 << 32 and zlib.crc32(b"") == 0
    assert packing.packed(none).count() == 0


def test_best_fit_takes_the_tightest():
    rng = random.Random(2)
    lengths = [rng.randint(1, 50) for _ in range(300)]
    got, n = packing.best_fit(lengths, 50)
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(50 - x)
    assert n == len(room)


def test_packing_ties_and_bounds(spark, monkeypatch):
    assert packing.best_fit([5, 5, 5, 5], 10) == ([(0, 0), (0, 5), (1, 0), (1, 5)], 2)
    monkeypatch.setattr(packing, "PIECES_HELD", 4)
    d = spark.createDataFrame([(i if i % 7 else None, ["", None, "same words", "same words"][i % 4], None, None, None, None, None) for i in range(80)], SCHEMA).coalesce(1)
    runs = [packing.packed(d).collect() for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 80 and sorted({r["length"] for r in runs[0]}) == [1, 3]
    for sid in {r["sequence_id"] for r in runs[0]}:
        at = 0
        for o, n in sorted((r["offset"], r["length"]) for r in runs[0] if r["sequence_id"] == sid):
            assert o == at
            at += n


def test_empty_results_and_names(spark, none, docs):
    assert quality_rules.keep_good(none, none.select("doc_id")).count() == 0 and secrets.redacted(none).count() == 0
    odd = docs.withColumns({"_text": F.lit("x"), "_h": F.lit(1), "score": F.lit(9.0), "th": F.lit(2), "pos": F.lit(3), "votes": F.lit("v")})
    for f in (quality_model.quality, line_dedup.line_dedup, simhash.near_dedup, exact_dedup.exact_dedup, packing.packed, secrets.secret_spans):
        assert f(odd).count() >= docs.count()
    assert quality_rules.quality_rules(odd, odd.select("doc_id")).count() == docs.count() and sample_pieces.sampled(odd, sample_pieces.piece_model()).count() > 0
    lab = docs.filter("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("y"))
    assert toxicity.toxicity(odd, lab).count() == docs.count()


def test_token_rollup(spark, docs, none, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path))
    rows = token_counts.counted(docs, token_counts.public_versions())
    known = rows.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "tokenizer"])
    assert roll.apply("1", inserts=known) and not roll.apply("1", inserts=known)

    def totals():
        return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in roll.totals().collect()}

    def direct(df):
        return {(r["source"], r["lang"], r["tokenizer"]): (r["d"], r["t"], r["c"]) for r in df.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"), F.sum("chars").alias("c")).collect()}

    assert totals() == direct(known)
    roll.apply("2", deletes=docs.filter("doc_id < 5").select("doc_id"))
    assert totals() == direct(known.filter("doc_id >= 5"))
    revised = known.filter("doc_id = 7").withColumns({"tokens": F.lit(1000).cast("long"), "lang": F.lit("fr")})
    assert roll.apply("3", revisions=revised) and not roll.apply("3", revisions=revised)
    assert totals() == direct(known.filter("doc_id >= 5 AND doc_id <> 7").unionByName(revised))
    lost = rows.filter("doc_id IS NULL")
    roll.apply("3b", inserts=lost, revisions=lost)  # rows without an id: inserted once, never revised
    assert totals() == direct(known.filter("doc_id >= 5 AND doc_id <> 7").unionByName(revised).unionByName(lost))
    roll.apply("4", deletes=docs.select("doc_id"))
    assert totals() == direct(lost) and token_counts.counted(none, token_counts.public_versions()).count() == 0


def test_token_counts_equal_whole_texts(spark, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    rows = [(i, t, ["en", "fr"][i % 2], ["a", "b", None][i % 3], 0) for i, t in enumerate(texts())]
    rows += [rows[4], (None, "no id here", "en", "a", 0), (None, "no id here", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    byte = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    want = defaultdict(lambda: [0, 0, 0])
    for _, t, lang, source, _ in rows:
        for name, n in (("word_bpe_49k@1", len(word.encode(t or "", add_special_tokens=False).ids)), ("byte_bpe_50k@1", len(byte.encode_ordinary(t or "")))):
            for k, x in enumerate((1, n, len(t or ""))):
                want[source, lang, name][k] += x
    got = token_counts.op3_token_counts(spark, str(tmp_path)).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"], r["n_chars"]] for r in got} == want


def often_by_hand(spot, token, size):
    return token != line_dedup.ANY and spot[token] >= 2 and spot[token] >= line_dedup.SHARE * size


def parts_by_hand(own, n, depth=0):
    """The parts of a leaf's lines, with the counts of tokens at each position."""
    spots = [Counter(m.split(" ")[p] for *_, m in own) for p in range(n)]
    fixed, able = 0, []
    for p in range(3, n):
        words = {t: k for t, k in spots[p].items() if t != line_dedup.ANY}
        fixed += sum(k for t, k in words.items() if often_by_hand(spots[p], t, len(own)))
        if len(words) >= 2 and 2 * sum(k for k in words.values() if k >= 2) >= len(own):
            able.append((len(words), p))
    if depth == line_dedup.DEPTH or not able or fixed >= line_dedup.CONSTANT * len(own) * (n - 3):
        return [(own, spots)]
    groups = defaultdict(list)
    for x in own:
        groups[x[3].split(" ")[min(able)[1]]].append(x)
    return [part for some in groups.values() for part in parts_by_hand(some, n, depth + 1)]


def brute_lines(rows):
    """Dropped line numbers of every row, by the same rules in plain Python."""
    blank = re.compile(r"[\x20\x09\x0B-\x0D]+")

    def masked(line):
        m = blank.sub(" ", line).strip(" ")
        ts = m.split(" ")
        if len(ts) < 3:
            return m
        v = [line_dedup.ANY if re.search("[0-9]", t) else t for t in ts]
        return " ".join(v) if 1 - v.count(line_dedup.ANY) / len(v) >= line_dedup.CONSTANT else m

    found = [(d, k, i, masked(x)) for k, (d, t) in enumerate(rows) for i, x in enumerate((t or "").split("\n"))]
    th = [xxhash.xxh64_intdigest((t or "").encode(), 42) for _, t in rows]
    found = [((2**63 - 1 if d is None else d, th[k] - (th[k] >> 63 << 64)), k, i, m) for d, k, i, m in found if m]
    leaves = defaultdict(list)
    for d, k, i, m in found:
        leaves[len(m.split(" ")), tuple(m.split(" ")[:3])].append((d, k, i, m))
    place = {}
    for leaf, own in leaves.items():
        plain = len({m for *_, m in own}) == 1 or len({d for d, *_ in own}) == 1
        for part, spots in [(own, None)] if plain else parts_by_hand(own, leaf[0]):
            for d, k, i, m in part:
                if not plain:
                    sk = [t if often_by_hand(spots[p], t, len(part)) else line_dedup.ANY for p, t in enumerate(m.split(" "))]
                    if sum(t != line_dedup.ANY for t in sk[3:]) / max(1, leaf[0] - 3) >= line_dedup.CONSTANT:
                        m = " ".join(sk)
                place[d, k, i] = leaf, m
    first, last = {}, {}
    for (d, _, _), t in place.items():
        first[t], last[t] = min(d, first.get(t, d)), max(d, last.get(t, d))
    out = defaultdict(list)
    for (d, k, i), t in place.items():
        if first[t] < last[t] and d != first[t]:
            out[k].append(i)
    return {k: ",".join(map(str, sorted(out[k]))) for k in range(len(rows))}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    forms = ["user {} logged in from city {}", "error {} at line {} of file main", "the {} is {}", "read 1{} bytes in {} ms", "{} {}", "a b c {} e f g {}"]
    some = [f"t{k}" for k in range(9)] + ["7", "12", "x9"]
    rows = [(i if i % 11 else None, "\n".join(rng.choice(forms).format(rng.choice(some), rng.choice(some)) for _ in range(rng.randint(0, 7)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t\n"), (5, "error t1 at line t2 of file main\nown line of five"), rows[7], rows[11]]
    rows += [(None, f"shared by rows without id\nown text {k * 'x'}") for k in range(6)]
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)
    want = brute_lines(rows)
    got = Counter((r["doc_id"], r["text"], r["dropped"]) for r in line_dedup.line_dedup(d).collect())
    left = lambda t, gone: "\n".join(x for k, x in enumerate((t or "").split("\n")) if str(k) not in gone.split(","))
    assert got == Counter((i, left(t, want[k]), want[k]) for k, (i, t) in enumerate(rows)) and sum(map(bool, want.values())) > 30
    assert sum(want[k] == "0" for k in range(len(rows) - 6, len(rows))) == 5


def test_crowded_leaves_are_split(spark):
    """Templates that share their length and leading tokens are told apart, whatever their number; prose is left alone."""
    rng = random.Random(5)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    for kinds in (2, 3, 4, 8, 30):
        forms = [" ".join(["in the log", *rng.sample(words, 2), "{}", *rng.sample(words, 2), "{}", rng.choice(words)]) for _ in range(kinds)]
        rows = [(i * kinds + k, f.format(rng.choice(words), rng.choice(words))) for i in range(12) for k, f in enumerate(forms)]
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)).collect()}
        assert sum(got.values()) >= 0.9 * 11 * kinds and not any(got[k] for k in range(kinds)), kinds
        want = brute_lines(rows)
        assert got == {i: int(want[k] != "") for k, (i, _) in enumerate(rows)}
    prose = [(i, "in the log " + " ".join(rng.choices(words, k=8))) for i in range(200)]
    got = line_dedup.line_dedup(spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in prose], SCHEMA))
    assert {r["n_dropped"] for r in got.collect()} == {0}


def test_samples_of_repeated_ids(spark):
    from brasstack.llm import common

    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") % 100).alias("votes"))
    got = common.fewest(rows, 5000, 100).collect()
    assert len(got) == 100 and len({r["votes"] for r in got}) < 10  # copies of a row have one hash
    apart = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("votes"))
    assert len({r["votes"] for r in common.fewest(apart, 5000, 100).collect()}) == 100
    same = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("votes"))
    assert common.fewest(same, 5000, 100).count() == 100


def test_line_dedup(spark, docs, none):
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect() if r["doc_id"] is not None}
    ids = [i for i, t in enumerate(texts()) if t and t.startswith("shared line")]
    assert [out[i]["n_dropped"] for i in ids] == [0, 2, 2, 2]  # own <*> number of the text is one template
    assert out[ids[1]]["text"] == "" and out[ids[0]]["text"] == texts()[ids[0]]
    assert out[47]["text"] == "" and out[47]["n_dropped"] == 0 or texts()[47] != ""
    assert line_dedup.line_dedup(docs).count() == docs.count() and line_dedup.line_dedup(none).count() == 0
    heads = [f"user {n} logged in from city {c} today" for n, c in zip("abcdefgh", "qrstuvwx")]
    d = spark.createDataFrame([(i, "first words " + x.split()[1] + "\nthe user was logged in from " + x.split()[-2], None, None, None, None, None) for i, x in enumerate(heads)], SCHEMA)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_dedup(d).collect()}
    assert got[0] == "" and all(got[i] == "1" for i in range(1, 8))  # the city varies, the short line doesn't recur
    clean = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i}", None, None, None, None, None) for i in range(5)], SCHEMA.replace("text string", "text string"))
    assert {r["n_dropped"] for r in line_dedup.line_dedup(clean).collect()} == {0}


def test_leading_tokens_make_no_template(spark):
    own = [f"was erlytion that {a}\nwas erlytion that {a} {b}\nwas erlytion that {b} {a} x{b}" for a, b in zip("abcdefgh", "qrstuvwx")]
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(own)], SCHEMA)
    assert {r["n_dropped"] for r in line_dedup.line_dedup(d).collect()} == {0}


def test_short_lines_recur_as_they_are(spark):
    own = ["Les.\nAnd ornd.\nPage 7\n\n中文的一行", "Les.\nAnd ornd.\nPage 8\n\n中文的一行", "And other.\nLes.\nLes"]
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(own)], SCHEMA)
    assert {r["doc_id"]: r["dropped"] for r in line_dedup.line_dedup(d).collect()} == {0: "", 1: "0,1,4", 2: "1"}


def test_sampled_pieces(docs, none):
    m = sample_pieces.Pieces(sample_pieces.piece_model())
    for t in ["a  b\n c", "Hello   world ", " lead\t x", "é漢字\n\n", *[t for t in texts()[:20] if t]]:
        got = sample_pieces.top_k(t, 7, 3, m)
        assert all(m.decode(x[3]) == t for x in got) and len({x[3] for x in got}) == len(got)
        assert [x[1] for x in got] == sorted((x[1] for x in got), reverse=True) and all(0 <= x[2] <= 1 for x in got)
        assert got == sample_pieces.top_k(t, 7, 3, m)
    rows = sample_pieces.sampled(docs, sample_pieces.piece_model())
    back = sample_pieces.decoded(rows, sample_pieces.piece_model()).filter("doc_id = 2").collect()
    assert [r["text"] for r in back] == [texts()[2]] * 2
    assert sample_pieces.sampled(none, sample_pieces.piece_model()).count() == 0


def test_lattice_memory_is_linear():
    import tracemalloc

    m = sample_pieces.Pieces(sample_pieces.piece_model())
    rng = random.Random(6)
    text = "".join(rng.choices("漢字仮名交文東京都中国人民", k=60_000))
    tracemalloc.start()
    lat = sample_pieces.Lattice(text, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20 and lat.likeliest()[-1] == len(text) and lat.ids(lat.likeliest()) == lat.best_ids()


def test_sampling_follows_the_model(monkeypatch):
    monkeypatch.setattr(sample_pieces, "TEMPER", 0.5)
    m = sample_pieces.Pieces(sample_pieces.piece_model())
    runs = [sample_pieces.top_k("the cat", s, 2, m) for s in range(3000)]
    p = {x[3]: np.exp(x[0]) for r in runs for x in r}
    first, both = Counter(r[0][3] for r in runs), Counter(x[3] for r in runs for x in r)
    for k, v in sorted(p.items(), key=lambda z: -z[1])[:5]:
        assert first[k] / 3000 == pytest.approx(v, abs=0.03)
        second = v + sum(q * v / (1 - q) for j, q in p.items() if j != k)  # without replacement
        assert both[k] / 3000 == pytest.approx(second, abs=0.04)


def test_toxicity(spark, none):
    rng = random.Random(0)
    words = [f"{a}{b}" for a in ("wor", "tal", "min", "ser") for b in ("ka", "lo", "mi", "ne", "po")]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        ws = rng.choices(words, k=30) + (rng.choices(["scumbag", "vilest", "foulness"], k=2) if bad else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "en", "s", 0, None, None))
        labels.append((i, int(bad) if rng.random() > 0.03 else int(not bad)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None), (5000, "", None, None, None, None, None)], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0 and r["doc_id"] < 600) for r in held) / len(held) > 0.97
    assert toxicity.toxicity(none, lab).count() == 0 and toxicity.toxicity(docs.limit(3), lab.limit(0)).count() == 3
    weights, bias, figures = toxicity.learn(docs, lab)
    assert {v[2:6] for v in figures["voters"]} == {"scum", "vile", "foul"}
    for r in got:  # scores are those of the weights on whole texts
        t = next((x[1] for x in rows if x[0] == r["doc_id"]), "")
        s = bias + sum(weights.get(toxicity.bucket(f), 0.0) for w in toxicity.words(t) for f in toxicity.features(w))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-s)))
    many = docs.unionByName(docs.filter("doc_id = 1").withColumn("text", F.explode(F.expr("transform(sequence(1, 500), x -> concat(text, x))"))))
    assert toxicity.sample(many, lab).count() <= 600


def test_label_model_needs_no_labels():
    rng = np.random.default_rng(1)
    y = rng.random(5000) < 0.15
    on = rng.uniform(0.1, 0.4, 12)
    v = (rng.random((5000, 12)) < np.where(y[:, None], on, 0.0005)).astype(float)
    v = np.column_stack([v, v[:, 0], v[:, 0]])  # two copies of a voter
    post, figures = weak.label_model(v, 0.15)
    fired = v.sum(1) > 0
    assert ((post > 0.5) == y)[fired].mean() > 0.95 and abs(figures["fires_on"][3] - on[3]) < 0.08
    assert figures["share"][0] == pytest.approx(1 / 3, abs=0.05) and weak.unlike(v, 20) == list(range(12))


def test_quality_model(spark, none):
    rng = random.Random(0)
    prose = lambda: "\n".join(" ".join(rng.choices(["we", "saw", "them", "walk", "home", "again", *(f"w{c}" for c in "abcdefghijklmnop")], k=20)).capitalize() + "." for _ in range(4))
    junk = [lambda: " ".join(w + "%%%" for w in prose().split()), lambda: prose().upper().replace(" ", "!! "), lambda: prose().replace(" ", " | ").replace(".", ""), lambda: " ".join(["same"] * 90)]
    rows = [(i, junk[i % 4]() if i % 5 == 0 else prose(), None, None, None, None, None) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in quality_model.quality(docs).collect()}
    assert sum(got[i]["kept"] == (i % 5 != 0) for i in range(300)) / 300 > 0.98 and not got[None]["kept"]
    assert quality_model.quality(none).count() == 0
    measured = quality_model.measured(docs)
    w, b, _ = quality_model.learn(measured)
    shapes = quality_model.Shapes()
    for i, t, *_ in rows[:40]:
        s = b + sum(w[k] * np.float32(v) for k, v in quality_model.measure(t, shapes)[1].items())
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-s)), abs=1e-9)


def test_dawid_skene_finds_the_poor_labeller():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.7
    acc = [0.95, 0.9, 0.85, 0.55]
    v = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in acc], 1)
    patterns, n = np.unique(v, axis=0, return_counts=True)
    post, rates, prior = weak.dawid_skene(patterns, n)
    assert abs(prior - 0.7) < 0.05 and [round(float(rates[1, j, 1]), 1) for j in range(4)] == pytest.approx(acc, abs=0.06)


def test_units_solved_at_once_equal_single_ones(monkeypatch):
    monkeypatch.setattr(sample_pieces, "AT_ONCE", 50)
    m = sample_pieces.Pieces(sample_pieces.piece_model())
    some = ["Hello   world", "é漢字\n\n x\0y 🙂", "ab" * 90, " a     b", "", None, *texts()[:20]]
    m.meet([sample_pieces.units(t or "") for t in some])
    for u in {u for t in some for u in sample_pieces.units(t or "")}:
        one = sample_pieces.Lattice(u, m)
        assert m.raw[m.known[u]] == one.best_ids()
        assert m.lps[m.known[u]] == pytest.approx(min(0.0, one.best[0][0] - one.below[0]), abs=1e-9)


def test_other_ways_follow_the_lattice(monkeypatch):
    monkeypatch.setattr(sample_pieces, "TEMPER", 0.5)
    m = sample_pieces.Pieces(sample_pieces.piece_model())
    lat = m.lattice("▁cats")
    got = m.others(["▁cats", "▁cats漢"] * 4000, [(i + 0.5) / 8000 for i in range(8000)])
    best = tuple(lat.likeliest())
    seen = Counter(tuple(np.frombuffer(e, "<u4").tolist()) for e, _, _ in got[::2])
    assert best not in seen
    for way, k in seen.items():
        assert k / 4000 == pytest.approx(np.exp(lat.log_prob(list(way))) / (1 - np.exp(lat.log_prob(list(best)))), abs=0.001)
    for e, ids, lp in got[::2]:
        path = np.frombuffer(e, "<u4").tolist()
        assert ids == lat.ids(path) and lp == pytest.approx(lat.log_prob(path), abs=1e-9)
    assert all(m.decode(ids) == "cats漢" for _, ids, _ in got[1::2])


def test_searches_in_step_equal_single_ones():
    m, one = (sample_pieces.Pieces(sample_pieces.piece_model()) for _ in range(2))
    some = [*texts()[:12], None, "", "x" * 200]
    assert sample_pieces.top_ks(some, list(range(15)), 3, m) == [sample_pieces.top_k(t, i, 3, one) for i, t in enumerate(some)]

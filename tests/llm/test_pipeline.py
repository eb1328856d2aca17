import random

import corpus_pipeline
from brasstack.llm import secrets, simhash


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("be", "ta", "mo", "si", "ru") for b in ("ka", "lo", "mi", "ne", "po", "du")]
    prose = [" ".join(rng.choices(words, k=120)) for _ in range(30)]
    apart = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    near = next(t for w in words for k in (118, 119) if (t := " ".join([*prose[0].split()[:k], w])) != prose[0] and apart(t, prose[0]) <= 2)
    leak = next(t for i in range(3, 30) for n in range(99) if apart(t := f"{prose[i]} {words[n % 30]} password=abcdef123{n:02d}", prose[i]) > 2 and all(apart(t, p) > 2 for p in prose))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*prose, prose[1], prose[2].replace(" ", "\n"), near, "too short", None, leak])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: sorted(r["doc_id"] for r in v) for k, v in seen.items()}
    assert ids["quality_rules"] == [*range(33), 35]
    assert ids["exact_dedup"] == [*range(30), 32, 35]
    assert ids["simhash"] == [*range(30), 35]
    assert all(not secrets.find(r["text"]) and r["n_chars"] == len(r["text"]) for r in seen["secret_scan"])
    assert [r["doc_id"] for r in seen["secret_scan"] if "[SECRET]" in r["text"]] == [35]
    assert set(ids["packing"]) == set(ids["secret_scan"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["packing"])

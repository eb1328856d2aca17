import difflib
import random

import pytest
from pyspark.sql import functions as F

from brasstack.functions import text as T
from brasstack.operators import dedup, metrics, models, sample, select
from brasstack import scratch
from brasstack.plans import queries
from brasstack.plans.completer import PerPartition, Replay
from brasstack.sources import scans


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [("The answer is B", "B"), ("I think a pulley works", "A"), ("C) do it", "C"), ("Option: (d)", "D"), ("none here!", None), ("the best choice is clearly B", "C"), ("answer is because B", "B"), ("éA foo", None)])
def test_option_letter(spark, text, want):
    assert one(spark, T.option_letter(F.lit(text))) == want


@pytest.mark.parametrize("text,keys,want", [("He was buying it", ["buy"], ["buy"]), ("worked well", ["work"], ["work"]), ("electrical", ["electric"], ["electric"]), ("a motorcycle", ["motor"], []), ("", ["x"], []), ("text", [], []), ("use the electric, motor!", ["!!", "motor electric"], ["motor electric"])])
def test_guard(spark, text, keys, want):
    assert one(spark, T.triggered(F.lit(text), F.array(*map(F.lit, keys)).cast("array<string>"))) == want
    assert one(spark, T.triggered(F.lit(text), keys)) == want


def test_small_functions(spark):
    assert [one(spark, T.budget_tier(F.lit(b))) for b in ("₹0", "₹50", "₹200", "₹500", "x")] == [0, 50, 200, 50, -1]
    assert one(spark, T.strip_html(F.lit("<b>a</b> \t b\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, T.dedup_tokens(F.lit("The (rope) is of Rope, tin!"))) == ["the", "rope", "tin"]
    assert one(spark, select.problem_id(select.instance_id(F.lit("SEED_007"), F.lit(3)))) == "JR-1K-007-03"
    assert one(spark, T.file_stem(F.lit("a/b c-é"))) == "a_b_c-é"


def test_kappa(spark):
    def kappa(a, b):
        return metrics.cohens_kappa(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()["kappa"]

    assert kappa([0, 1, 2, 3], [0, 1, 2, 3]) == 1.0
    assert kappa([0, 0, 3, 3], [3, 3, 0, 0]) <= 0
    assert kappa([1, 1], [1, 1]) is None


def test_accuracy_counts_unread_answers_and_ignores_unknown(spark):
    c = spark.createDataFrame([("m", 1, "A"), ("m", 2, None), ("m", 9, "A"), ("m", 1, "b")], "model_name string, problem_id long, selected_option string")
    t = spark.createDataFrame([(1, "A"), (2, "B")], "problem_id long, truth string")
    assert metrics.mcq_accuracy(c, t, ["model_name"]).first()["accuracy"] == pytest.approx(1 / 3)
    assert metrics.mcq_accuracy(c.limit(0), t, []).first()["accuracy"] == 0.0


def test_failure_modes(spark):
    rows = spark.createDataFrame([(2, 0, 1, False), (1, 1, 0, False), (2, 1, 0, False), (0, 0, 0, True), (3, 1, 1, False)], "total_score int, constraint_adherence int, physical_viability int, auto_fail boolean")
    assert tuple(metrics.failure_modes(rows, []).first()) == (1, 2, 1, 4)


def test_scores_follow_keys_not_positions(spark):
    g = spark.createDataFrame([(2, "clean", []), (1, "auto_fail", ["motor"])], "problem_id int, filter_result string, triggered_keywords array<string>")
    s = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 0)], "problem_id int, constraint_adherence int, inventory_utilization int, physical_viability int")
    got = {r["problem_id"]: (r["total_score"], r["reason"]) for r in metrics.two_stage(g, s).collect()}
    assert got == {2: (2, None), 1: (0, "AUTO_FAIL: forbidden keywords ['motor']")}


@pytest.mark.parametrize("count", [3, 10, 27, 40])
def test_profiles(spark, count):
    space = sample.constraint_space(spark)
    assert space.count() == 27
    seeds = spark.createDataFrame([(f"SEED_{i:03d}",) for i in range(5)], "seed_id string")
    for f in (sample.stratified_exact, sample.stratified_hash):
        rows = f(seeds, space, count).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, f(seeds, space, count).collect()))
        for s in {r["seed_id"] for r in rows}:
            own = [tuple(r)[2:] for r in rows if r["seed_id"] == s]
            assert len(own) == len(set(own)) == min(count, 27)
            if count >= 9:
                assert all(len({o[a] for o in own}) == 3 for a in range(3))


def test_options(spark):
    p = spark.createDataFrame([("JR-1K-001-01", ["r", "x", "y", "z"])], "problem_id string, options array<string>")
    r = sample.shuffle_options(p).first()
    assert r[r["answer"]] == "r" and sorted(r[k] for k in "ABCD") == ["r", "x", "y", "z"]


def test_greedy_settles_chains(spark):
    items = spark.createDataFrame([(i, "") for i in range(4)], "ord long, text string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert sorted(r["ord"] for r in dedup.greedy(items, pairs).collect()) == [0, 2]


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.sample(words, 12)) for _ in range(40)]
    texts += [t + " extra" for t in texts[:10]] + ["", "a an"] + [" ".join(rng.sample(t.split(), 12)) for t in texts[:5]]
    texts += [" ".join(rng.sample(words, k)) for k in (1, 1, 2, 3, 18, 24, 27, 30) for _ in range(4)]
    items = spark.createDataFrame([*enumerate(texts), (999, None)], "ord long, text string")
    sets = [frozenset(w.lower().strip(T.PUNCTUATION) for w in t.split() if len(w) > 2) for t in texts]
    reps = {}
    for i, x in enumerate(sets):
        reps.setdefault(x, i)
    got = {r["ord"]: r["rep"] for r in dedup.token_classes(items).collect()}
    assert got == {i: reps[x] for i, x in enumerate(sets) if x} and any(i != r for i, r in got.items())
    own = sorted(r for x, r in reps.items() if x)
    want = {(i, j) for i in own for j in own if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.65}
    assert {(r["a"], r["b"]) for r in dedup.jaccard_pairs(items).collect()} == want and want
    near = {(r["a"], r["b"]): r["similarity"] for r in dedup.ratio_pairs(items).collect()}
    assert all(v == pytest.approx(difflib.SequenceMatcher(None, texts[b].lower(), texts[a].lower()).ratio()) for (a, b), v in near.items())
    assert {(i, 40 + i) for i in range(10)} <= near.keys()


def test_ratio_pairs_are_complete(spark):
    rng = random.Random(2)
    slots = [f"{a}{b}{c}" for a in "bdgkmp" for b in "aeiou" for c in ("rst", "lnd", "xy", "qu")]
    frame = "the common frame of every one of these strings, which they share: "
    texts = [frame + " ".join(rng.sample(slots, rng.choice((4, 8)))) for _ in range(60)]
    texts += [" ".join(rng.choices(slots, k=rng.choice((12, 50, 90)))) for _ in range(60)]
    texts += [t[:k] + "Zq" + t[k + 9 :] for t in texts[60:100] for k in (10, 40)] + [frame * 5, frame * 6, "", "", "ab", "abc", "İİİ", "e" * 300, "e" * 300]
    ratio = lambda a, b: difflib.SequenceMatcher(None, texts[b].lower(), texts[a].lower()).ratio()
    items = spark.createDataFrame([*enumerate(texts), (999, None)], "ord long, text string")
    rep = {}
    for i, t in enumerate(texts):
        same = difflib.SequenceMatcher(None, t.lower(), t.lower()).ratio() >= 0.65
        rep[i] = next((k for k in range(i) if same and texts[k].lower() == t.lower()), i)
    assert {r["ord"]: r["rep"] for r in dedup.ratio_classes(items).collect()} == rep
    own = [i for i, r in rep.items() if i == r]
    want = {(a, b): r for a in own for b in own if a < b and (r := ratio(a, b)) >= 0.65}
    got = dedup.ratio_pairs(items).collect()
    assert len(got) == len(want) > 1000 and {(r["a"], r["b"]): r["similarity"] for r in got} == want


def test_greedy_equals_a_pass_by_both_tests(spark, tmp_path):
    rng = random.Random(5)
    words = ["walk", "talked", "run", "house", "garden", "window", "table", "river", "stone", "cloud", "paper", "light"]
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(25)]
    texts += [t.replace(" ", "s ") + "s" for t in texts[:8]] + [t.replace(" ", "") for t in texts[8:14]] + ["at it is on", "at it is in", "", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets, kept, by_ratio = [{w.lower().strip(T.PUNCTUATION) for w in t.split() if len(w) > 2} for t in texts], [], 0
    for i, t in enumerate(texts):
        same = any(sets[i] and sets[k] and len(sets[i] & sets[k]) / len(sets[i] | sets[k]) >= 0.65 for k in kept)
        like = not same and any(difflib.SequenceMatcher(None, t.lower(), texts[k].lower()).ratio() >= 0.65 for k in kept)
        by_ratio += like
        if not same and not like:
            kept.append(i)
    assert by_ratio and sorted(r["ord"] for r in queries.QUERIES["dedup_greedy"](spark, str(tmp_path)).collect()) == kept


def test_ratio_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_ROWS", 7)
    monkeypatch.setattr(dedup, "_BLOCK", 3)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc", k=rng.choice((10, 14, 20, 210, 260)))) for _ in range(70)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, texts[b], texts[a]).ratio()
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if ratio(a, b) >= 0.65}
    got = dedup.ratio_pairs(spark.createDataFrame(list(enumerate(texts)), "ord long, text string")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want and want


def test_quota_and_numbers(spark):
    rows = spark.createDataFrame([(i, "b" if i % 3 else "a") for i in range(12)], "ord int, domain string")
    got = select.quota(rows, {"b": 2, "a": 1}, ["a", "b"], 6).orderBy("place").collect()
    assert [r["ord"] for r in got] == [1, 2, 0, 3, 6, 9]
    assert [r["position"] for r in select.number(rows, ["ord"]).orderBy("ord").collect()] == list(range(1, 13))
    assert select.number(rows.limit(0), ["ord"]).count() == 0


def test_numbers_of_many_rows_with_other_columns(spark, tmp_path):
    n = 200_000
    rows = spark.range(n, numPartitions=9).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    select.number(rows, ["k"]).write.parquet(str(tmp_path / "numbered"))
    got = spark.read.parquet(str(tmp_path / "numbered"))
    assert got.count() == n and got.filter("position <> k + 1").isEmpty() and got.columns == ["k", "payload", "position"]


def test_prices(spark):
    prices = spark.createDataFrame([(0, "gpt-4o", 1.0, 1.0), (1, "gpt-4o-mini", 2.0, 2.0)], "ord int, price_key string, per_k_in double, per_k_out double")
    models = spark.createDataFrame([("gpt-4o-mini-2024-07-18",), ("gpt-4o-mini",), ("other",)], "model_name string")
    got = {r["model_name"]: r["per_k_in"] for r in select.priced(models, prices, (9.0, 9.0)).collect()}
    assert got == {"gpt-4o-mini-2024-07-18": 1.0, "gpt-4o-mini": 2.0, "other": 9.0}


def test_validation(spark):
    ok = ("SEED_001", "healthcare", "g" * 20, "m" * 10, ["rope"], "r" * 5)
    bad = ("INVALID_ID", "x", "short", None, ["  ab "], "r")
    df = spark.createDataFrame([ok, bad], "seed_id string, domain string, target_goal string, core_physics_mechanism string, historical_materials_used array<string>, source_reference string")
    checked = select.validate(df, models.seed_rules())
    assert {r["seed_id"]: len(r["errors"]) for r in checked.collect()} == {"SEED_001": 0, "INVALID_ID": 6}
    assert select.require_some(checked).count() == 1
    with pytest.raises(ValueError):
        select.require_some(checked.filter("not valid"))


def test_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\n')
    assert sorted(r["x"] for r in scans.jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    pages = spark.createDataFrame([(1, "http://h/a/", '<div>MARK<h3>One</h3><a href="b/1">go</a><b>Headed</b><p>' + "body " * 8 + "</p></div>"), (2, "u", None)], "page_id long, url string, html string")
    card = scans.html_cards(pages, "MARK", "<h3>(.*?)</h3>", 'href="([^"]+)"').first()
    assert (card["title"], card["link"]) == ("One", "b/1")
    assert scans.links(pages, ["b/"]).first()["href"] == "http://h/a/b/1"
    assert [r["title"] for r in scans.newsletter_entries(pages).collect()] == ["Headed"]
    words = spark.createDataFrame([(1, 10.0, 5.0, "b"), (1, 9.0, 1.0, "a"), (1, 13.0, 0.0, "c"), (1, 15.5, 0.0, "d")], "page long, top double, x0 double, text string")
    assert [r["text"] for r in scans.layout_lines(words).orderBy("line").collect()] == ["a b c", "d"]
    at = [(1, 600.0, 279.0)] * 11 + [(1, 600.0, 320.0)] * 11 + [(2, 600.0, 280.0)] * 11 + [(2, 600.0, 320.0)] * 11 + [(3, 600.0, 10.0)] * 10 + [(3, 600.0, 500.0)] * 20
    assert {r["page"]: r["two_columns"] for r in scans.two_columns(spark.createDataFrame(at, "page long, width double, x0 double")).collect()} == {1: True, 2: False, 3: False}
    said = spark.createDataFrame([("v", "fr", 0, "f"), ("v", "hi", 1, "h" * 5001), ("w", "fr", 0, "x")], "video_id string, language string, ord int, text string")
    assert {r["video_id"]: r["text"] for r in scans.transcript(said).collect()} == {"v": "h" * 5000 + "\n[... transcript truncated ...]", "w": "x"}


def test_completers(spark):
    prompts = spark.createDataFrame([("a", "p"), ("b", "q")], "key string, prompt string")
    got = {r["key"]: r["error"] for r in Replay(prompts.limit(1).withColumn("raw_output", F.lit("o"))).complete(prompts).collect()}
    assert got == {"a": None, "b": "no recorded output"}

    def client():
        def call(p):
            if p == "q":
                raise RuntimeError("no")
            return p.upper()
        return call

    assert {(r["key"], r["raw_output"], r["error"]) for r in PerPartition(client, 2).complete(prompts).collect()} == {("a", "P", None), ("b", None, "no")}


def test_early_stop(spark):
    cards = spark.createDataFrame([("c", 1, 0, "a"), ("c", 1, 1, "b"), ("c", 2, 0, "a"), ("c", 3, 0, "z")], "category string, page int, pos int, t string")
    assert sorted(r["t"] for r in select.pages_until_stop(cards, F.col("t")).collect()) == ["a", "b"]


def test_keep_first_and_shared_folder(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 1, None)], "k string, o int, _row string")
    assert sorted(tuple(r) for r in dedup.keep_first(rows, F.col("k"), ["o"]).collect() if r["k"]) == [("a", 1, "y")]
    assert dedup.keep_first(rows, F.col("k"), ["o"]).filter("k IS NULL").first()["_row"] is None

    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch.shared_dir(Far)
    df = scratch.cut(rows, "x")
    assert df.count() == 4
    scratch.drop(df)
    assert scratch.cut(rows, "y").columns == rows.columns

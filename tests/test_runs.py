"""Configuration, prompts, rules, scans of pages and files, sinks, calls and whole runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brasstack.functions import prompts as P
from brasstack.operators import metrics, models, sample, select
from brasstack.plans import drivers
from brasstack.plans.completer import PerPartition, Throttle, attempts
from brasstack.sources import config, scans, sinks

CONFIG = """
data:
  seed_target_count: 4
  domain_distribution: {agriculture: 2, healthcare: 1}
  paths: {seeds: "d/seeds"}
constraints:
  financial: ["₹0 budget", "₹50 budget", "₹200 budget"]
  environmental: ["heat", "flood", "dust"]
  infrastructural: ["no grid", "no signal", "no transport"]
models:
  frontier:
    - {name: a, provider: openai, model_id: a-1}
  indic_native:
    - {name: b, provider: vllm, model_id: b-1, max_tokens: 7}
"""


def test_config(spark, tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text(CONFIG, encoding="utf-8")
    (tmp_path / "pyproject.toml").write_text("")
    c = config.load_config(tmp_path / "c.yaml")
    assert c["eval"]["judge"]["kappa_threshold"] == 0.8 and c["data"]["mutations_per_seed"] == 10 and c["plots"]["dpi"] == 300
    assert config.data_path(c, "seeds") == "./d/seeds" and config.data_path(c, "raw", "/x/") == "/x/data/raw"
    assert [(r["ord"], r["tier"], r["name"], r["max_tokens"]) for r in config.model_dim(spark, c).orderBy("ord").collect()] == [(0, "frontier", "a", 1024), (1, "indic_native", "b", 7)]
    assert [r["name"] for r in config.only(config.model_dim(spark, c), ["b"]).collect()] == ["b"] and config.domain_dim(spark, c).count() == 2
    assert models.require_space(sample.constraint_space(spark, config.axes(c))).filter("budget = '₹50 budget'").count() == 9
    with pytest.raises(ValueError, match="27"):
        models.require_space(sample.constraint_space(spark, {"budget": ("x",)}))
    with pytest.raises(ValueError, match="data.domain_distribution, constraints.financial"):
        config.parse_config({})
    with pytest.raises(ValueError, match="models.frontier"):
        config.parse_config({**c, "models": {"frontier": [{"name": "x"}]}})
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert config.project_root(tmp_path / "a" / "b") == tmp_path
    monkeypatch.setenv("MY_KEY", "k")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert config.api_key("openai", "MY_KEY") == "k"
    for bad in ("openai", "nobody"):
        with pytest.raises(ValueError):
            config.api_key(bad)


def text(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_prompts(spark):
    got = text(spark, P.extraction_prompt(), source="s", url_or_path="u", raw_text="r" * 5000, title="", innovator_name="I", location="L", category="C")
    assert "Source: s\nPath/URL: u\n" in got and "\n" + "r" * 4000 + "\n--- END" in got and "- Title: N/A\n- Innovator: I\n" in got
    got = text(spark, P.mutation_prompt(), target_goal="g", core_physics_mechanism="m", domain="d", historical_materials_used=["a", "b"], budget="x", environment="y", infrastructure="z")
    assert "- Original Materials: a, b\n\nAPPLIED CONSTRAINTS:\n- Budget: x\n- Environment: y\n- Infrastructure: z\n\nGenerate:" in got
    got = text(spark, P.judge_prompt(F.lit("ctx"), F.struct(F.lit("x").alias("budget"), F.lit("y").alias("environment"), F.lit("z").alias("infrastructure")), F.array(F.lit("rope"), F.lit("tin")),
                                     F.struct(F.array(F.lit("e")).alias("essential_keywords"), F.array(F.lit("f"), F.lit("h")).alias("forbidden_keywords"), F.lit("lever").alias("required_physical_mechanism")), F.lit("out")), a="")
    assert got.startswith("## Problem Context\nctx\n\n## Constraints\n- Budget: x\n") and "## Available Inventory\nrope, tin\n\n" in got and "- Forbidden keywords: f, h\n" in got and "Evaluate\nout\n\nNow evaluate" in got
    assert text(spark, P.usage(F.lit(0), F.col("t")), t="x" * 9) == 3 and text(spark, P.usage(F.lit(5), F.col("t")), t="x") == 5

    import pandas as pd

    def counter(s: pd.Series) -> pd.Series:
        return s.str.split().str.len()

    assert text(spark, P.token_count(F.col("t"), counter), t="a b c") == 3


def errors(spark, schema, rules, *rows):
    return [sorted(r["errors"]) for r in select.validate(spark.createDataFrame(list(rows), schema), rules).collect()]


def test_rules_of_all_models(spark):
    assert errors(spark, "source string, url_or_path string, raw_text string", models.raw_case_rules(), ("s", "u", "r" * 20), ("s", None, "short")) == [[], ["raw_text", "url_or_path"]]
    inst = "instance_id string, seed_id string, domain string, target_goal string, core_physics_mechanism string, applied_constraints struct<budget:string>, adjusted_inventory array<string>, context_narrative string, original_materials array<string>"
    assert errors(spark, inst, models.instance_rules(), ("MI_001_01", "SEED_001", "healthcare", "g", "m", ("x",), ["r"], "n" * 20, ["o"]), ("MI_1_1", "S", "x", "g", "m", ("x",), [], "n", None)) == [[], ["adjusted_inventory", "context_narrative", "domain", "instance_id", "original_materials"]]
    prob = "problem_id string, domain string, prompt_context string, mcq_options struct<A:string,B:string,C:string,D:string>, ground_truth_option string, ground_truth_synthesis_rubric struct<essential_keywords:array<string>,forbidden_keywords:array<string>,required_physical_mechanism:string>"
    ten = "o" * 10
    assert errors(spark, prob, models.problem_rules(), ("JR-1K-001-01", "healthcare", "c" * 50, (ten,) * 4, "C", (["e"], ["f"], "m" * 10)), ("INVALID", "healthcare", "c" * 49, (ten, ten, ten, "o"), "E", ([], ["f"], "m"))) == [
        [], ["essential_keywords", "ground_truth_option", "mcq_options", "problem_id", "prompt_context", "required_physical_mechanism"]]
    res = "mcq_global_accuracy double, open_gen_global_average_score double, domain_performance map<string,struct<mcq:double,open_gen:double>>, failure_modes struct<constraint_violations:int,physical_hallucinations:int,task_abandonment:int>"
    assert errors(spark, res, models.result_rules(), (0.5, 3.0, {"d": (1.0, 0.0)}, (412, 318, 149)), (1.5, 3.1, {"d": (1.0, 4.0)}, (0, -1, 0))) == [[], ["domain_performance", "failure_modes", "mcq_global_accuracy", "open_gen_global_average_score"]]
    s = spark.createDataFrame([("r", 1, 0, 1, 1), ("r", 2, 0, 0, 2)], drivers.SCORE)
    assert [r["total_score"] for r in models.scored(s).collect()] == [2]
    a = [("src", "u", "S9", "space", "g" * 20, "m" * 10, [" rope ", "tin"], ""), ("src", "u", None, "healthcare", " " * 30, "m" * 10, ["rope"], "ref of it"), ("src", "u", None, "healthcare", "g" * 20, "m" * 10, ["ab"], "ref of it")]
    got = models.extracted(spark.createDataFrame(a, "source string, url_or_path string, " + drivers.SEED)).collect()
    assert [(r["seed_id"], r["domain"], r["source_reference"], r["historical_materials_used"]) for r in got] == [("SEED_000", "agriculture", "src: u", ["rope", "tin"])]
    assert models.size_report(s, 2)["complete"] and not models.size_report(s, 3)["complete"]


def card(title, desc, by=None, link="x/innovation/detail/1"):
    return scans.CARD + f'<h3> {title} </h3><a href="{link}">v</a>' + (f"<span><strong>By : </strong> {by} </span>" if by else "") + f"<p>{desc} <a href='y'>View More</a></p></div>"


def test_card_cases(spark):
    pages = [(7, 0, card("One", "d1", "Ann") + card("Two", "d2")), (7, 1, card("one", "again")), (7, 2, card("Three", "behind the end")), (3, 0, card("THREE", "d3") + "<h3>no card</h3>"), (3, 1, " "), (3, 2, card("Four", "d")),
             (5, 0, None), (9, 1, card("Five", "no page before")),
             (2, 0, card("Seven", "s") + card("four", "not hidden"))]
    got = scans.card_cases(spark.createDataFrame(pages, "category int, page int, html string"), [7, 3, 5, 9, 2], "web").collect()
    assert {(r["title"], r["category"], r["innovator_name"]) for r in got} == {("One", "7", "Ann"), ("Two", "7", None), ("THREE", "3", None), ("Seven", "2", None), ("four", "2", None)}
    assert {r["raw_text"] for r in got} == {"Title: One\nDescription: d1\nInnovator: Ann\n", "Title: Two\nDescription: d2\n", "Title: THREE\nDescription: d3\n", "Title: Seven\nDescription: s\n", "Title: four\nDescription: not hidden\n"}


def test_newsletters(spark):
    body = "a body of over thirty characters, really"
    page = f'<h3>Outside it</h3><p>{body}</p><div><div class="x Content"><h3>First <i>one</i></h3><p>{body}</p><p>more</p><b>not a title</b>loose<h4>Tiny</h4><p>too short it is</p><strong>Bold title</strong>loose text of it <h2>Third</h2><p>{body}</p></div><p>still in</p></div><h3>Late</h3><p>{body}</p>'
    loose = "<h3>A pump</h3><p>By Ram Lal, a farmer from village Rampur. It lifts water.</p></div>"
    box = "<div><div class='content'>%s</div></div>"
    nested = f"<div><div class='node-content'><h2>Outer</h2><p>{body}</p><div><div class='content'><h3>Inner entry</h3><p>{body}</p></div></div><h3>Not inside</h3><p>{body}</p></div></div>"
    expect = lambda *x: [(t, b, None, None) for t, b in x]
    cases = [
        (page, expect(("First one", f"{body}\nmore not a title loose"), ("Bold title", "too short it is loose text of it"), ("Third", f"{body}\nstill in"))),
        (loose, [("A pump", "By Ram Lal, a farmer from village Rampur. It lifts water.", "Ram Lal", "village Rampur")]),
        (None, []), ("<div class='content'><h3>Open entry</h3><p>" + body, []),
        (box % f"<h2>Par</h2><b>Real title</b><p>{body}</p><b>no title</b> tail", expect(("Real title", f"{body} no title tail"))),
        (box % "<p>a lost <h2>Title &amp; more</h2><p>one<!-- c --> two</p><p/>loose &eacute; text<script>if (a < b) x</script>", expect(("Title & more", "one two loose é text if (a < b) x"))),
        (nested, expect(("Outer", body), ("Inner entry", body))),
        (box % f"<p>{body}</p>untitled loose", expect(("", body))), (box % "<h2>Title here</h2>short", [])]
    met = scans.newsletter_entries(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "page_id long, html string")).orderBy("page_id", "pos").collect()
    for i, (_, want) in enumerate(cases):
        assert [tuple(r)[2:] for r in met if r["page_id"] == i] == want
    pages = spark.createDataFrame([(1, "u1", "Vol 1", page), (2, "u2", "Vol 2", page + loose), (3, "u3", "Vol 3", loose)], "page_id long, url string, issue string, html string")
    got = scans.newsletter_cases(pages, "news", "Bee").collect()
    assert sorted((r["url_or_path"], r["title"]) for r in got) == [("u1", "Bold title"), ("u1", "First one"), ("u1", "Third"), ("u3", "A pump")]
    assert next(r["raw_text"] for r in got if r["url_or_path"] == "u3").endswith("\nSource: Bee — Vol 3")
    index = [(0, "http://h/i/", '<a href="issue1.html"> Issue <b>one</b></a><a href="/vol2">Two</a><a href="issue3"></a><a href="about">x</a>'), (1, "http://h/j/", '<a href="http://h/vol2">again</a>')]
    got = scans.issue_links(spark.createDataFrame(index, "ord long, url string, html string"), "http://h").orderBy("ord", "pos").collect()
    assert [(r["url"], r["title"]) for r in got] == [("http://h/i/issue1.html", "Issue one"), ("http://h/vol2", "Two")]
    root = [(0, "http://h", "<A HREF='x/1'>Grassroot news</A><a href='y'>no</a><a class=q href=\"honey\">abc</a>"), (1, "http://h/k", None)]
    got = scans.issue_links(spark.createDataFrame(root, "ord long, url string, html string"), "http://h").orderBy("pos").collect()
    assert [(r["url"], r["title"]) for r in got] == [("http://h/x/1", "Grassroot news"), ("http://h/honey", "abc")]


def test_segments(spark):
    long = "word " * 25
    numbered = f"intro\n1. Water lifter\nInnovator: Ram Lal\n{long}\n(2) Seed drill from Gujarat.\n{long}\n[3]) Third\nCategory: farming\n{long}\n4. short"
    titles = f"head\nWATER LIFTER\n{long}\nCHAPTER IV\n{long}\nSEED DRILL\n{long}\nTREE CLIMBER\n{long}"
    breaks = f"a {long}\n\n\nb {long}\n\n\n\nshort\n\n\nc {long}"
    got = spark.createDataFrame([("n", numbered), ("t", titles), ("b", breaks), ("e", ""), ("z", None)], "id string, text string")
    rows = scans.segments(got).collect()
    by = {k: [r["title"] for r in rows if r["id"] == k] for k in "ntb"}
    assert by["n"] == ["Water lifter", "Seed drill from Gujarat.", "Third"] and by["t"] == ["WATER LIFTER", "SEED DRILL", "TREE CLIMBER"] and len(by["b"]) == 3
    assert {r["id"] for r in rows} == {"n", "t", "b"} and "CHAPTER IV" in rows[3]["segment"]
    first, second, third = (r for r in rows if r["id"] == "n")
    assert first["innovator_name"].startswith("Ram Lal") and second["location"] == "Gujarat" and third["category"] == "farming"
    assert scans.segment_cases(got, "pdf").filter("length(raw_text) < 100").count() == 0


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"a")
    (tmp_path / "b.pdf").write_bytes(b"b")

    def extract(content):
        if content == b"b":
            raise ValueError("broken")
        two = [(1, 600.0, 10.0 * i, x, f"{side}{i}") for i in range(11) for side, x in (("l", 20.0), ("r", 400.0))]
        return [*two, (2, 600.0, 5.0, 30.0, "z"), (2, 600.0, 4.0, 90.0, "y"), (2, 600.0, 50.0, 1.0, "x")]

    words = scans.pdf_words(spark, str(tmp_path / "*.pdf"), extract)
    got = scans.page_texts(words).collect()
    assert [r["text"] for r in got] == ["\n".join(f"l{i}" for i in range(11)) + "\n\n" + "\n".join(f"r{i}" for i in range(11)) + "\n\ny z\nx"]


def test_videos(spark):
    found = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "c"), (1, "d"), (2, "e")], "step int, video_id string")
    assert sorted(r[0] for r in scans.video_ids(found, 4).collect()) == ["a", "b", "c", "d"] and scans.video_ids(found, 2).count() == 3 and scans.video_ids(found, 9).count() == 5
    v = spark.createDataFrame([("a", " Title ", "desc", [f"t{i}" for i in range(25)], "ch"), ("b", "t", "", [], "")], "video_id string, title string, description string, tags array<string>, channel string")
    t = spark.createDataFrame([("a", "said")], "video_id string, text string")
    got = scans.video_cases(v, t, "video", "http://v/").collect()
    assert [(r["url_or_path"], r["raw_text"]) for r in got] == [("http://v/a", "Title: Title\n\nDescription: desc\n\nTags: " + ", ".join(f"t{i}" for i in range(20)) + "\n\nChannel: ch\n\nTranscript:\nsaid")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m/1", "mcq", i, f"o{i}") for i in range(4)], "model_name string, mode string, problem_id long, raw_output string")
    for some in (df.filter("problem_id < 3"), df, df.unionAll(df)):
        sinks.append_completions(some, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.export_array(df, str(tmp_path / "arr"), ["problem_id"])
    assert [r["problem_id"] for r in json.loads(next((tmp_path / "arr").glob("part-*")).read_text())] == [0, 1, 2, 3]
    assert scans.json_array(spark, str(tmp_path / "arr"), "problem_id long, raw_output string").count() == 4
    with pytest.raises(Exception):
        (tmp_path / "bad.json").write_text('[{"problem_id": "x"}]')
        scans.json_array(spark, str(tmp_path / "bad.json"), "problem_id long").collect()
    score = df.select("model_name", "problem_id", F.lit(1).alias("total_score"))
    for one in (score, score.withColumn("model_name", F.lit("n")), score.limit(2)):
        sinks.overwrite_scores(one, str(tmp_path / "scores"))
    assert {r["model_name"]: r["count"] for r in spark.read.parquet(str(tmp_path / "scores")).groupBy("model_name").count().collect()} == {"m/1": 2, "n": 4}
    (tmp_path / "x_mcq_completions.jsonl").write_text('{"raw_output": "a"}\n')
    got = scans.with_model_from_file(spark.read.schema("raw_output string").json(str(tmp_path / "*_mcq_completions.jsonl")), only=["x"]).collect()
    assert [r["model_file"] for r in got] == ["x"]
    (tmp_path / "strict.jsonl").write_text('{"x": 1}\n{bad\n')
    with pytest.raises(Exception):
        scans.jsonl(spark, str(tmp_path / "strict.jsonl"), "x int", tolerant=False).collect()


def test_calls_are_throttled_and_retried(spark):
    now, slept = [0.0], []
    gate = Throttle(2, 60, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        gate.acquire()
    assert now[0] == pytest.approx(60) and len(slept) == 2
    tried, waits = [], []

    def call():
        tried.append(1)
        if len(tried) < 4:
            raise RuntimeError("busy")
        return "done"

    assert attempts(call, 5, 1.0, 3.0, 0.0, sleep=waits.append) == "done" and waits == [1.0, 2.0, 3.0]
    with pytest.raises(RuntimeError):
        attempts(lambda: (_ for _ in ()).throw(RuntimeError("x")), 2, 0.0, 0.0, 0.0, sleep=lambda s: None)

    def client():
        seen = {}

        def ask(p):
            seen[p] = seen.get(p, 0) + 1
            if seen[p] < int(p[-1]):
                raise RuntimeError("busy")
            return p.upper()

        return ask

    prompts = spark.createDataFrame([("a", "p1"), ("b", "q3"), ("c", "r9")], "key string, prompt string")
    got = {r["key"]: (r["raw_output"], r["error"]) for r in PerPartition(client, 2, per_minute=6000, tries=3, first=0.0, most=0.0).complete(prompts).collect()}
    assert got == {"a": ("P1", None), "b": ("Q3", None), "c": (None, "busy")}


class Scripted:
    """Answers by a function of key and prompt; None fails."""

    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompts):
        answer = self.answer

        def run(frames):
            for f in frames:
                f["raw_output"] = [answer(k, p) for k, p in zip(f["key"], f["prompt"])]
                f["error"] = [None if r is not None else "down" for r in f["raw_output"]]
                yield f[["key", "raw_output", "error"]]

        return prompts.mapInPandas(run, "key string, raw_output string, error string")


GOALS = ["Irrigate a plot without any electric pump", "Irrigate the plot without any electric pump", "Keep vaccines cool on long walks uphill", "", "Lift bricks to a roof with one person only", "Carry fruit over a river in flood time"]


def test_from_raw_cases_to_results(spark):
    cases = spark.createDataFrame([(i, "web", f"u{i}", f"raw text number {i} of the cases", None, None, None, None) for i in range(7)], "ord long, " + drivers.RAW_CASE)

    def seed(key, prompt):
        i = int(key)
        assert f"raw text number {i} " in prompt
        if i == 6:
            return None if key == "6" else ""
        return json.dumps({"domain": ["agriculture", "agriculture", "healthcare", "healthcare", "construction", "space"][i], "target_goal": GOALS[i], "core_physics_mechanism": "lever and pulley", "historical_materials_used": ["rope", " tin "], "source_reference": ""})

    seeds = drivers.extract_seeds(cases, Scripted(seed), {"healthcare": 1, "agriculture": 1}, 3)
    got = seeds.orderBy("position").collect()
    assert [(r["seed_id"], r["target_goal"]) for r in got] == [("SEED_001", GOALS[2]), ("SEED_002", GOALS[0]), ("SEED_003", GOALS[5])]
    assert got[0]["source_reference"] == "web: u2" and got[0]["historical_materials_used"] == ["rope", "tin"]
    again = drivers.finalise_seeds(seeds.withColumn("ord", -F.col("position")).withColumn("target_goal", F.when(F.col("position") == 1, "bad").otherwise(F.col("target_goal"))))
    assert [(r["seed_id"], r["target_goal"]) for r in again.orderBy("position").collect()] == [("SEED_001", GOALS[5]), ("SEED_002", GOALS[0])]

    def adjust(key, prompt):
        if key == "MI_002_01":
            return "not json"
        if key == "MI_003_02":
            return None
        return json.dumps({"adjusted_inventory": ["rope", "tin"], "context_narrative": "Asha stands in a village near the river.", "reasoning": "r"})

    done, failed = drivers.mutate(seeds.drop("position"), sample.constraint_space(spark), Scripted(adjust), 2)
    assert sorted(r["instance_id"] for r in done.collect()) == ["MI_001_01", "MI_001_02", "MI_002_02", "MI_003_01"]
    assert {r["instance_id"]: r["error"] for r in failed.collect()} == {"MI_002_01": None, "MI_003_02": "down"}

    def formatted(key, prompt):
        if key in ("MI_001_02", "MI_003_01", "MI_003_01#2") or key.startswith("MI_002_02"):
            return json.dumps({"prompt_context": "short"}) if "#" not in key else None
        long = {"correct_option": "the right way to do it", "distractors": {"abundance_distractor": "buy it all online", "brute_force_distractor": "carry it all by hand", "wrong_mechanism_distractor": "use rope as a pipe"}}
        return json.dumps({"prompt_context": "Asha has rope and tin in the heat and must lift water by noon today.", **long, "essential_keywords": ["rope"], "forbidden_keywords": ["motor"], "required_physical_mechanism": "lever and pulley"})

    problems, bad = drivers.format_problems(done, Scripted(formatted))
    rows = {r["problem_id"]: r for r in problems.collect()}
    assert set(rows) == {"JR-1K-001-01", "JR-1K-001-02", "JR-1K-003-01"} and [r["instance_id"] for r in bad.collect()] == ["MI_002_02"]
    for k, r in rows.items():
        order = [0, 1, 2, 3]
        sample.generator(k).shuffle(order)
        assert r["ground_truth_option"] == "ABCD"[order.index(0)] and r["mcq_options"][r["ground_truth_option"]] == "the right way to do it"
    assert set(sinks.projections(problems)["mcq"].columns) == set(problems.columns) - {"ground_truth_synthesis_rubric"}

    names = spark.createDataFrame([("m1",), ("m2",)], "model_name string")
    truth = {k: r["ground_truth_option"] for k, r in rows.items()}

    def answer(key, prompt):
        model, mode, problem = key.split("/")
        if model == "m2" and problem.endswith("003-01"):
            return None
        if mode == "mcq":
            return f"The answer is {truth[problem] if model == 'm1' else 'none'}"
        return "buy a motor" if problem.endswith("001-02") else "lift it by lever and rope"

    old = spark.createDataFrame([("m1", "mcq", "JR-1K-001-01")], "model_name string, mode string, problem_id string")
    left, _ = drivers.run_benchmark(problems, names, "mcq", Scripted(answer), old)
    assert left.count() == 4
    mcq, lost = drivers.run_benchmark(problems, names, "mcq", Scripted(answer))
    opengen, _ = drivers.run_benchmark(problems, names, "opengen", Scripted(answer))
    assert mcq.count() == 5 and [(r["model_name"], r["problem_id"], r["error"]) for r in lost.collect()] == [("m2", "JR-1K-003-01", "down")]

    def score(key, prompt):
        assert "motor" not in prompt.split("## Model Output")[1]
        return json.dumps({"reasoning": "ok", "constraint_adherence": 1, "inventory_utilization": 1, "physical_viability": int(key.startswith("m1")), "total_score": 0})

    checked = drivers.verify(opengen, problems, Scripted(score))
    assert {(r["model_name"], r["problem_id"]): r["total_score"] for r in checked.collect()} == {
        ("m1", "JR-1K-001-01"): 3, ("m1", "JR-1K-001-02"): 0, ("m1", "JR-1K-003-01"): 3, ("m2", "JR-1K-001-01"): 2, ("m2", "JR-1K-001-02"): 0}
    with pytest.raises(ValueError, match="no valid score"):
        drivers.judge(opengen, problems, Scripted(lambda k, p: None if k == "m2/JR-1K-001-01" else json.dumps({"reasoning": "", "constraint_adherence": 1, "inventory_utilization": 1, "physical_viability": 1})))
    out = {r["model_name"]: r for r in drivers.results(mcq, checked, problems).collect()}
    assert out["m1"]["mcq_accuracy"] == 1.0 and out["m2"]["mcq_accuracy"] == 0.0 and out["m1"]["open_gen_average"] == 2.0 and out["m2"]["task_abandonments"] == 1
    assert sum(d["open_gen"] for d in out["m1"]["domain_performance"].values()) > 0 and set(out["m1"]["budget_tier_performance"]) <= {"₹0", "₹50", "₹200"}
    assert drivers.results(mcq, checked.filter("problem_id = 'JR-1K-001-01'"), problems, judged_only=True).select("n_completions").distinct().first()[0] == 1
    human = checked.filter("model_name = 'm1'").select("problem_id", F.col("total_score").alias("score"))
    assert {r["model_name"]: r["valid"] for r in drivers.calibration(human, checked, least=3).collect()} == {"m1": True}
    frames = drivers.plot_frames(drivers.results(mcq, checked, problems))
    assert frames["discriminative"].count() == 4 and frames["failures"].first()["task_abandonments"] == pytest.approx(2 / 3) and frames["scarcity"].count() >= 2
    generated = drivers.generated_cases(Scripted(lambda k, p: json.dumps([{"url_or_path": "u", "raw_text": "t" * 20}, {"url_or_path": "u", "raw_text": "t"}])), "make some", "made", spark)
    assert [r["source"] for r in generated.collect()] == ["made"]


def test_sources_that_fail_are_left_out(spark):
    good, bad = select.attempted({"a": lambda: spark.range(2), "b": lambda: spark.read.json("/nowhere/at/all"), "c": lambda: spark.range(3)})
    assert select.chosen(good).count() == 5 and select.chosen(good, ["c", "b"]).count() == 3 and list(bad) == ["b"]
    assert [r["id"] for r in select.head(spark.range(9), ["id"], 2).collect()] == [0, 1]


def test_exact_draws(spark):
    """As Python's own generator draws: one pick for each axis value, then a sample, then a shuffle."""
    space = [(b, e, i) for b in sample.BUDGETS for e in sample.ENVIRONMENTS for i in sample.INFRASTRUCTURES]
    import hashlib

    for key in ("SEED_001", "SEED_002", "SEED_017"):
        rng = random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest(), "big"))
        left, want = list(space), []
        for axis, values in enumerate((sample.BUDGETS, sample.ENVIRONMENTS, sample.INFRASTRUCTURES)):
            for v in values:
                want.append(rng.choice([c for c in left if c[axis] == v]))
                left.remove(want[-1])
        want += rng.sample(left, 1)
        rng.shuffle(want)
        got = sample.stratified_exact(spark.createDataFrame([(key,)], "seed_id string"), sample.constraint_space(spark)).orderBy("k").collect()
        assert [tuple(r)[2:] for r in got] == want
    assert sample.profiles_for("SEED_001", space, 10) == [16, 26, 7, 9, 23, 17, 0, 2, 19, 22]

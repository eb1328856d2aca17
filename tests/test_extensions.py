"""The data source of links, functions in SQL, the bucket's state, the committed sink, observed counts."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brasstack.functions import catalog
from brasstack.functions import text as T
from brasstack.operators import select
from brasstack.sources import listing
from brasstack.streaming import bucket, committed


def test_page_links(spark, tmp_path, capsys):
    rows = [(k, f"{'https' if k % 3 else 'http'}://h{k % 2}.org/x", f'<a class="c" href="/{k}">a</a><p><a href="">e</a><a href=x>no</a>') for k in range(20)]
    rows += [(20, None, '<a href="/n">'), (21, "no scheme", '<a href="/s">'), (22, "https://h0.org", None), (None, "https://h1.org/", '<a href="/i">')]
    table = pa.table({"page_id": pa.array([r[0] for r in rows], "int64"), "url": [r[1] for r in rows], "html": [r[2] for r in rows]})
    (tmp_path / "p").mkdir()
    pq.write_table(table, tmp_path / "p" / "a.parquet", row_group_size=6)
    src = listing.page_links(spark, str(tmp_path / "p"))
    everything = {tuple(r) for r in src.collect()}
    assert len(everything) == src.count() == 43 and (20, None, None, 0, "/n") in everything and (21, None, None, 0, "/s") in everything and (3, "http", "h1.org", 1, "") in everything
    at, https = str(tmp_path / "p"), lambda r: r[1] == "https"
    for asked, test in (
        ({"scheme": "https"}, https), ({"hosts": ["h1.org", "h9.org"], "from_page": 4, "to_page": 15}, lambda r: r[2] == "h1.org" and r[0] is not None and 4 <= r[0] < 15),
        ({"hosts": ["h0.org"]}, lambda r: r[2] == "h0.org"), ({"from_page": 1000}, lambda r: False), ({}, lambda r: True)):
        assert {tuple(r) for r in listing.page_links(spark, at, **asked).collect()} == {r for r in everything if test(r)}, asked
    for text, test in (("scheme = 'https'", https), ("page_id <= 2 OR host = 'h0.org'", lambda r: (r[0] is not None and r[0] <= 2) or r[2] == "h0.org"), ("page_id = 7", lambda r: r[0] == 7), ("true", lambda r: True)):
        assert {tuple(r) for r in src.filter(text).collect()} == {r for r in everything if test(r)}, text  # one table, many plans
    some = listing.page_links(spark, at, scheme="https", from_page=4)
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(scheme,https)" in plan and "GreaterThanOrEqual(page_id,4)" in plan
    both = some.filter("page_id < 9").alias("a").join(some.filter("page_id < 12").alias("b"), "page_id", "right")
    assert {r["page_id"] for r in both.collect()} == {r[0] for r in everything if https(r) and r[0] is not None and 4 <= r[0] < 12}
    assert len(listing.LinkReader({"path": at}).partitions()) == 4 and [p.group for p in listing.LinkReader({"path": at, "from_page": "12"}).partitions()] == [2, 3]
    with pytest.raises(Exception, match="none.parquet"):
        listing.page_links(spark, str(tmp_path / "none.parquet")).collect()


def test_sql_functions(spark):
    assert catalog.register(spark) == ["word_stem", "stem_bag", "option_letter", "guard_hits"]
    texts = ["The answer is (b).", "Motors heating nations", "", None, "C) because", "ABC", "option: d", "running running runs"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = ["motor", "nation heat", "!!", "run"]
    got = df.selectExpr("t", "stem_bag(t) AS bag", "option_letter(t) AS letter", "guard_hits(t, array('motor', 'nation heat', '!!', 'run')) AS hits", "word_stem(t) AS w")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = df.select("t", T.stem_bag(F.col("t")).alias("bag"), T.option_letter(F.col("t")).alias("letter"), T.triggered(F.col("t"), words).alias("hits"), T.stem(F.col("t")).alias("w"))
    assert got.collect() == want.collect()


def released_by_hand(calls, rate, period):
    """One second of the clock at a time: a level that leaks, one waiting call let go when there is room."""
    gap = -(-period // rate)
    out, free = [], []
    for call, asked in sorted(calls, key=lambda c: (c[1], c[0])):
        # free holds the times at which earlier calls have leaked away; they leak one after the other
        at = asked
        while sum(f > at for f in free) >= rate:
            at += 1
        free.append(max(at, free[-1] if free else at) + gap)
        out.append((call, asked, at))
    return out


def test_bucket(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    calls = [("p", k, s) for k, s in enumerate([0, 0, 0, 1, 2, 2, 40, 41, 41, 41, 41, 90])] + [("q", 100, 3), ("q", 101, 95), (None, 102, 4)]
    frame = spark.createDataFrame([(p, k, base + dt.timedelta(seconds=s)) for p, k, s in calls], "provider string, call_id long, ts timestamp")
    for until, since in ((20, -1), (60, 20), (200, 60)):  # the stream is started again for each part
        frame.filter((F.unix_seconds("ts") - int(base.replace(tzinfo=dt.UTC).timestamp())).between(since + 1, until)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with committed.state_on_disk(spark):
            stream = bucket.released(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 3, 30_000)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    zero = int(base.replace(tzinfo=dt.UTC).timestamp()) * 1000
    got = {(r["provider"], r["call_id"], (r["asked_ms"] - zero) // 1000, (r["release_ms"] - zero) // 1000) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(p, *r) for p in "pq" for r in released_by_hand([(k, s) for q, k, s in calls if q == p], 3, 30)}
    assert got == {w for w in want if w[3] <= 95} and any(w[3] > w[2] for w in got)
    with pytest.raises(ValueError):
        bucket.Bucket(0, 1000)


SCHEMA = "problem_id long, model_name string, mode string, turn long"


def test_committed_sink(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "sink")
    frame = lambda ids, turn=0: spark.createDataFrame([(i, "m", "mcq", turn) for i in ids], SCHEMA)
    keys = lambda: sorted(r["problem_id"] for r in committed.committed(spark, root).collect())
    run = lambda writer, work=lambda df: df: committed.exactly_once(spark, src, SCHEMA, root, str(tmp_path / f"cp-{writer}"), writer, work)
    assert committed.committed(spark, root) is None
    frame([1, 2, 2]).write.parquet(src)

    class Killed(Exception):
        pass

    real = committed.CommitLog.commit

    def dies(*_):
        raise Killed("before the commit")

    def dies_late(*a):
        real(*a)
        raise Killed("behind the commit")

    try:
        committed.CommitLog.commit = dies
        with pytest.raises(Exception, match="before the commit"):
            run("a")
        assert committed.committed(spark, root) is None  # written aside, yet not there
        committed.CommitLog.commit = dies_late
        with pytest.raises(Exception, match="behind the commit"):
            run("a")
    finally:
        committed.CommitLog.commit = real
    assert keys() == [1, 2]
    run("a")  # the batch is in the log, so it is only taken forward
    frame([2, 3], 1).write.mode("append").parquet(src)
    run("a")
    assert keys() == [1, 2, 3]

    log = committed.CommitLog(spark, root)
    own = committed.CommitLog(spark, root)

    def overtaken(df):  # while c works, d commits 4 and 5
        committed.append_batch(frame([4, 5]), own, "d", 0, lambda x: x)
        return df

    assert committed.append_batch(frame([1, 4, 6, 6]), log, "c", 0, overtaken)
    assert keys() == [1, 2, 3, 4, 5, 6]
    assert not committed.append_batch(frame([9]), log, "c", 0, lambda x: x)  # that batch is done
    run("b")  # another stream over the same calls
    assert keys() == [1, 2, 3, 4, 5, 6]
    none = spark.createDataFrame([(None, "m", "mcq", 0)], SCHEMA)
    assert committed.append_batch(none, log, "n", 0, lambda x: x) and committed.append_batch(none, log, "n", 1, lambda x: x, own=True)
    assert committed.committed(spark, root).filter("problem_id IS NULL").count() == 1
    assert not [p for p in (tmp_path / "sink" / "_log").iterdir() if p.name.endswith(".tmp")] and sorted(e["version"] for e in log.entries()) == list(range(len(log.entries())))


def test_split_observed(spark, tmp_path):
    rules = {"a": F.col("x") > 0, "b": F.col("y") != "bad"}
    df = spark.createDataFrame([(1, "ok"), (-1, "bad"), (None, "ok"), (2, None), (3, "fine")], "x int, y string")
    good, bad, counts = select.split_observed(df, rules, str(tmp_path / "one"))
    assert sorted(map(tuple, good.collect())) == [(1, "ok"), (3, "fine")] and good.columns == ["x", "y"]
    assert sorted((r["x"] or 0, sorted(r["errors"])) for r in bad.collect()) == [(-1, ["a", "b"]), (0, ["a"]), (2, ["b"])]
    assert counts == {"rows": 5, "rejected": 3, "a": 2, "b": 2}
    with pytest.raises(ValueError, match="no valid row"):
        select.split_observed(df.filter("x < 0"), rules, str(tmp_path / "two"))
    good, bad, counts = select.split_observed(df.limit(0), rules, str(tmp_path / "three"))
    assert good.count() == bad.count() == 0 and counts == {"rows": 0, "rejected": 0, "a": 0, "b": 0}

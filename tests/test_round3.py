"""Findings of the third round, each with a case that failed before."""

import random

import duckdb
import numpy as np

import __spark_entry__ as entry
from brasstack.operators import dedup


def by_sql(name, tables):
    """The rows of a query's SQL over (name: path of a Parquet folder)."""
    con = duckdb.connect()
    for n, at in tables.items():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{at}/*.parquet')")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_newsletter_entries_read_references_as_their_sql(spark, tmp_path):
    body = "a body of over thirty characters, really"
    pages = [f"<h1>Cut title &amp;&amp</h1><p>{body} &copy</p>", f"<h2>Whole &amp; good</h2><p>{body}&middot;&nbsp;&quot;x&quot &am &a &</p>", f"<h3>Others &lt;b&gt; &eacute; &#39;</h3><p>{body} &amp;copy; &COPY;</p>"]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(at)
    got = entry.queries()["newsletter_entries"](spark, str(tmp_path)).collect()
    assert in_order(got) == in_order(by_sql("newsletter_entries", {"pages": at})) and len(got) == 3


def test_video_search_returns_every_video(spark, tmp_path):
    rows = [(u, v) for u in range(200) for v in ((500.0, 1.0) if u % 3 == 0 else (3.0,))]
    at = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(at)
    got = entry.queries()["video_search"](spark, str(tmp_path)).collect()
    assert {(r["video_id"], r["step"]) for r in got} == {(u, 0 if u % 3 == 0 else 1 + u % 5) for u in range(200)} and len(got) == 200
    assert in_order(got) == in_order(by_sql("video_search", {"events": at}))


def test_jaccard_pairs_carry_no_sets(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdgkmp" for b in "aeiou" for c in ("rst", "lnd", "xy", "qu")]
    texts = [" ".join(rng.sample(words, rng.choice((3, 9, 40, 90)))) for _ in range(120)]
    texts += [" ".join(rng.sample(t.split(), max(1, int(len(t.split()) * f))) + extra) for t in texts[:60] for f, extra in ((0.9, []), (0.7, []), (0.8, ["other"]))]
    sets = [frozenset(t.split()) for t in texts]
    reps = [i for i, x in enumerate(sets) if sets.index(x) == i]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in reps for j in reps if i < j}
    want = {k: v for k, v in want.items() if v >= 0.65}
    items = spark.createDataFrame([*enumerate(texts), (998, ""), (999, None)], "ord long, text string")
    joins = []
    close = dedup._close
    monkeypatch.setattr(dedup, "_close", lambda t: joins.append(t) or close(t))
    for counters, most in ((1 << 20, 64 << 20), (16, 0)):  # few counters and no broadcast give the same
        monkeypatch.setattr(dedup, "_COUNTERS", counters)
        monkeypatch.setattr(dedup, "_BITMAP_BYTES", most)
        got = dedup.jaccard_pairs(items).collect()
        assert len(got) == len(want) > 100 and {(r["a"], r["b"]): r["similarity"] for r in got} == want
    assert len(joins) == 2


def test_least_counts_in_few_bits():
    rng = np.random.default_rng(1)
    for most_x, most_y, kind in ((9, 9, "int16"), (90_000, 5, "int16"), (90_000, 90_000, "int32")):
        x, y = rng.integers(0, most_x, (30, dedup._CLASSES), "int32"), rng.integers(0, most_y, (20, dedup._CLASSES), "int32")
        got = dedup._least(x, y)
        assert got.dtype == kind and (got == np.minimum(x[:, None], y[None]).sum(2)).all()


def test_common_subsequences_side_by_side():
    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for j, e in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if c == e else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for m in (0, 1, 63, 64, 65, 128, 199):
        y = "".join(rng.choices("abcdeé漢 ", k=m))
        some = ["".join(rng.choices("abcdeé漢 xyz", k=rng.choice((0, 1, 30, 64, 100, 250)))) for _ in range(15)] + [y]
        assert dedup._common(some, y).tolist() == [plain(x, y) for x in some]

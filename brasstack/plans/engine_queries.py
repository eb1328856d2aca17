"""Queries of what extends the engine: the data source, functions in SQL, streaming state, the committed sink, observed counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstack.functions import catalog
from brasstack.operators import select
from brasstack.plans.fixtures import read, run, view
from brasstack.plans.queries import _GUARDED, _KEYWORDS, _OPTION, query
from brasstack.scratch import path
from brasstack.sources import listing
from brasstack.streaming import bucket, committed


@query(r"""SELECT page_id, host, CAST(k - 1 AS int) AS pos, href FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(x) AS href, generate_subscripts(x, 1) AS k
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS x FROM {pages})) f WHERE EXISTS (SELECT 1 FROM {pages} p WHERE p.page_id = f.page_id AND starts_with(p.url, 'https://'))""")
def page_links_source(spark, sf):
    """The scheme is the filter that goes down to the source."""
    return listing.page_links(spark, f"{sf}/pages.parquet", scheme="https").select("page_id", "host", "pos", "href")


@query(f"WITH {_GUARDED} SELECT problem_id, turn, {_OPTION} AS letter, coalesce(array_to_string(hits, '|'), '') AS triggered FROM guarded")
def sql_functions(spark, sf):
    """SQL text alone over the functions of the catalog."""
    catalog.register(spark)
    return run(spark, sf, f"SELECT problem_id, turn, option_letter(raw_output) AS letter, array_join(guard_hits(raw_output, array{_KEYWORDS.replace('[', '(').replace(']', ')')}), '|') AS triggered FROM {{completions}}")


# Parameters of the query: calls a period, and its length.
RATE, PERIOD_MS = 4, 4_800_000
_GAP = -(-PERIOD_MS // RATE)
SLICES = 3


@query(f"""WITH c AS (SELECT event_type AS provider, event_id AS call_id, epoch_us(ts) // 1000 AS asked_ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM {{events}}),
  e AS (SELECT *, k * {_GAP} + max(asked_ms - (k - 1) * {_GAP}) OVER (PARTITION BY provider ORDER BY k) AS empty FROM c),
  r AS (SELECT *, greatest(asked_ms, coalesce(lag(empty) OVER (PARTITION BY provider ORDER BY k) - {(RATE - 1) * _GAP}, asked_ms)) AS release_ms FROM e)
  SELECT provider, call_id, asked_ms, release_ms FROM r WHERE release_ms <= (SELECT max(asked_ms) FROM c)""")
def bucket_release(spark, sf):
    """Events as calls, their type as provider; they come in slices of time, and the stream is started again for each."""
    calls = read(spark, sf, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"))
    src, at, sink = path(spark, "calls"), path(spark, "bucket"), path(spark, "released")
    low, high = calls.agg(F.min("ts"), F.max("ts")).first()
    schema = "provider string, call_id long, ts timestamp"
    ends = [low + (high - low) * k / SLICES for k in range(1, SLICES)] if low else []
    for a, b in zip([None, *ends], [*ends, None]):
        part = calls.filter(F.lit(True) if a is None else F.col("ts") > a).filter(F.lit(True) if b is None else F.col("ts") <= b)
        part.write.mode("append").parquet(src)
        with committed.state_on_disk(spark):
            out = bucket.released(spark.readStream.schema(schema).parquet(src), RATE, PERIOD_MS)
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(bucket.RELEASED).parquet(sink)


@query("SELECT problem_id, model_name, 'mcq' AS mode, count(*) AS rows, 'a' AS writer FROM (SELECT DISTINCT problem_id, model_name FROM {completions}) GROUP BY ALL")
def committed_sink(spark, sf):
    """Two writers take the same calls, the first of them twice: each key is there once, by the writer that came first."""
    src, root = path(spark, "source"), path(spark, "committed")
    rows = view(spark, sf, "completions").select("problem_id", "model_name", F.lit("mcq").alias("mode"), "turn")
    at = {w: path(spark, f"writer-{w}") for w in "ab"}
    for writer in "aab":
        rows.write.mode("append").parquet(src)
        work = lambda df, w=writer: df.select("problem_id", "model_name", "mode", F.lit(w).alias("writer"))
        committed.exactly_once(spark, src, "problem_id long, model_name string, mode string, turn long", root, at[writer], writer, work)
    return committed.committed(spark, root).groupBy("problem_id", "model_name", "mode", "writer").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH v AS (SELECT doc_id, source, length(text) < 50 AS a, NOT regexp_matches(source, '^src[0-9]$') AS b, lang NOT IN ('en', 'de') AS c FROM {documents})
  SELECT 'row' AS kind, CAST(doc_id AS varchar) AS name, CAST(NOT (a OR b OR c) AS int)::bigint AS n FROM v UNION ALL
  SELECT 'count', unnest(['rows', 'rejected', 'text', 'source', 'lang']), unnest([count(*), count(*) FILTER (a OR b OR c), count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (c)]) FROM v""")
def quarantine_observed(spark, sf):
    """One job writes good and rejected rows apart and counts them by rule."""
    rules = {"text": F.length("text") >= 50, "source": F.col("source").rlike("^src[0-9]$"), "lang": F.col("lang").isin("en", "de")}
    good, bad, counts = select.split_observed(read(spark, sf, "documents"), rules, path(spark, "checked"))
    named = lambda df, n: df.select(F.lit("row").alias("kind"), F.col("doc_id").cast("string").alias("name"), F.lit(n).cast("long").alias("n"))
    totals = spark.createDataFrame([("count", k, n) for k, n in counts.items()], "kind string, name string, n long")
    return named(good, 1).unionByName(named(bad, 0)).unionByName(totals)

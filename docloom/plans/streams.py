"""Streaming jobs run to the end of the given files; the resulting table is the answer.

Each shares its SQL with the batch operator it must agree with.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.versions import format_version, make_version
from docloom.operators import ordered, scoring, store
from docloom.plans import fixtures, ledgers, storage
from docloom.plans.registry import query
from docloom.session import scratch_path
from docloom.sources import files
from docloom.streaming import jobs


@query("j1_ingest_dropdir", "WITH " + fixtures.ENTRIES + ", " + fixtures.STORE_BY_ENTRY + """
, first AS (SELECT key, min(page_ord) AS page_ord FROM entries JOIN entry_store USING (page_ord) GROUP BY key)
SELECT f.key, s.category, s.breaking, e.version_text AS release FROM first f JOIN entries e USING (page_ord) JOIN entry_store s USING (page_ord)""")
def ingest_dropdir(spark, sf_dir):
    """Saved lines dropped twice in differently cut files, plus lines that must be refused."""
    rows = storage.store_rows(spark, sf_dir)
    folder, root = scratch_path(spark, "drop"), scratch_path(spark, "store")
    files.write_jsonl(rows, f"{folder}/a")
    files.store_lines(rows.repartition(3)).unionByName(
        rows.select(F.concat(F.lit('{"key":"'), "key", F.lit('"}')).alias("value"))
    ).write.text(f"{folder}/b")
    jobs.ingest_drop_folder(spark, f"{folder}/*", root, scratch_path(spark, "checkpoint"))
    return store.read_snapshot(spark, root).select("key", "category", "breaking", "release")


_RULE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in scoring.RULES) + " ELSE 'other' END"


@query("j2_score_once", "WITH " + fixtures.ENTRIES + f"""
, first AS (SELECT key, arg_min(text, page_ord) AS text, arg_min(version_text, page_ord) AS release FROM entries GROUP BY key)
SELECT key, {_RULE_CASE} AS category, regexp_matches(text, '{scoring.BREAKING}') AS breaking, release FROM first""")
def score_once(spark, sf_dir):
    root, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "checkpoint")
    minor = F.substring("source", 4, 10).cast("int")
    stream = jobs.table_stream(spark, f"{sf_dir}/documents.parquet").select(
        "text", F.col("doc_id").alias("ord"), format_version(make_version(F.lit(1), minor, F.lit(0))).alias("release")
    )
    jobs.score_once(stream, root, checkpoint, (fixtures.PROMPT_VERSION, fixtures.MODEL, fixtures.EFFORT))
    return store.read_snapshot(spark, root).select("key", "category", "breaking", "release")


@query("j3_budget_ledger", ledgers.ADMITTED)
def budget_ledger(spark, sf_dir):
    out, checkpoint = jobs.stream_paths(spark, "budget")
    stream = ledgers.attempt_log(fixtures.attempts_from(jobs.table_stream(spark, f"{sf_dir}/events.parquet")))
    jobs.budget_ledger(stream, out, checkpoint, ledgers.CAPS)
    return spark.read.parquet(f"{out}/decisions").select("run_id", "serial", "refusal", "admitted")


@query("j4_latency_windows", """
WITH e AS (SELECT epoch_us(ts) AS us, value, event_type, epoch_us(ts) // 3600000000 * 3600 AS window_start FROM events)
SELECT window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(quantile_cont(value, 0.95), 9) AS p95
FROM e WHERE (window_start + 3600) * 1000000 <= (SELECT max(us) FROM e) - 600000000 GROUP BY window_start""")
def latency_windows(spark, sf_dir):
    """Hourly windows that the watermark has closed, ten minutes behind the newest event."""
    out, checkpoint = jobs.stream_paths(spark, "windows")
    events = jobs.table_stream(spark, f"{sf_dir}/events.parquet")
    stream = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    jobs.latency_histogram(stream, out, checkpoint, "1 hour", "10 minutes")
    histogram = spark.read.parquet(out).withColumn("window_start", F.unix_seconds("window_start"))
    counts = histogram.groupBy("window_start").agg(
        F.sum("n").alias("requests"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0)).alias("errors")
    )
    ranks = ordered.quantiles(histogram, ["window_start"], F.col("value"), {"p95": 0.95}, weight=F.col("n")).drop("n")
    return counts.join(ranks, "window_start").withColumn("p95", F.round("p95", 9))


@query("j5_orphan_timeout", ledgers.UNFINISHED)
def orphan_timeout(spark, sf_dir):
    out, checkpoint = jobs.stream_paths(spark, "claims")
    events = jobs.table_stream(spark, f"{sf_dir}/events.parquet")  # other events only move the clock
    stream = events.select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "finish").otherwise("other").alias("kind"),
    )
    jobs.orphan_timeout(stream, out, checkpoint, 24 * ledgers.HOUR_US)
    return spark.read.parquet(f"{out}/orphans").select("user_id", "event_id", "ts_us")


@query("j6_stop_reason", ledgers.FIRST_FAILURE.replace("GROUP BY run_id", "GROUP BY run_id HAVING count(reason) > 0"))
def stop_reason(spark, sf_dir):
    out, checkpoint = jobs.stream_paths(spark, "reasons")
    jobs.stop_reasons(fixtures.attempts_from(jobs.table_stream(spark, f"{sf_dir}/events.parquet")), out, checkpoint)
    return jobs.read_stop_reasons(spark, out).select("run_id", F.col("reason").alias("stop_reason"), F.col("ts_us").alias("stopped_at"))


@query("j7_ttl_snapshot", """
WITH e AS (SELECT user_id AS url, epoch_us(ts) AS us, event_type, event_id, (SELECT max(epoch_us(ts)) FROM events) AS now FROM events)
SELECT url, max(us) AS fetched_us, arg_max(CAST(event_id AS VARCHAR), us) AS body, any_value(now) - max(us) > 43200000000 AS expired
FROM e WHERE event_type <> 'error' GROUP BY url""")
def ttl_snapshot(spark, sf_dir):
    out, checkpoint = jobs.stream_paths(spark, "fetches")
    events = jobs.table_stream(spark, f"{sf_dir}/events.parquet")
    stream = events.select(
        F.col("user_id").alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("fetched_us"),
        F.col("event_id").cast("string").alias("body"), (F.col("event_type") != "error").alias("ok"),
    )
    jobs.latest_fetches(stream, out, checkpoint)
    latest = jobs.read_fetches(spark, out)
    newest = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))))
    return jobs.with_expiry(latest, newest.scalar(), 12 * ledgers.HOUR_US)

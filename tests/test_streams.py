"""Streams fed in several micro-batches end like their batch twins."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import ledger, metrics, store
from docloom.plans import fixtures, ledgers, storage
from docloom.plans.registry import table
from docloom.sources import files
from docloom.streaming import jobs


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """Events in five files in time order, one per micro-batch."""
    folder = str(tmp_path_factory.mktemp("events") / "table")
    rows = table(spark, sf, "events")
    for i in range(5):
        rows.filter(f"event_id div 200 = {i}").coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return jobs.table_stream(spark, folder, files_per_batch=1)


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_budget(spark, sf, events, tmp_path):
    out = str(tmp_path / "out")
    caps = {"max_requests": 20, "max_output": 60_000, "max_input": 90_000, "time_limit_s": 15 * 86400.0}
    jobs.budget_ledger(ledgers.attempt_log(fixtures.attempts_from(stream(spark, events))), out, str(tmp_path / "c"), caps)
    decided = spark.read.parquet(f"{out}/decisions")
    assert decided.select("epoch").distinct().count() == 5
    batch = ledger.admit_under_caps(ledgers.attempt_log(fixtures.attempts(spark, sf)), **caps)
    same(decided.select("run_id", "serial", "refusal"), batch.select("run_id", "serial", "refusal"))


def test_orphans(spark, sf, events, tmp_path):
    out, hour = str(tmp_path / "out"), ledgers.HOUR_US
    shaped = lambda df: df.filter(F.col("event_type").isin("view", "purchase")).select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(F.col("event_type") == "view", "claim").otherwise("finish").alias("kind"),
    )
    jobs.orphan_timeout(shaped(stream(spark, events)), out, str(tmp_path / "c"), 24 * hour)
    rows = shaped(table(spark, sf, "events"))
    newest = rows.agg(F.max("ts_us")).first()[0]
    due = rows.filter(f"kind = 'claim' AND ts_us + {24 * hour} < {newest}")
    batch = ledger.unfinished_claims(due, rows.filter("kind = 'finish'"), "user_id", 24 * hour)
    columns = ["user_id", "event_id", "ts_us"]
    same(spark.read.parquet(f"{out}/orphans").select(*columns), batch.select(*columns))


def test_stop_reasons(spark, sf, events, tmp_path):
    out = str(tmp_path / "out")
    jobs.stop_reasons(fixtures.attempts_from(stream(spark, events)), out, str(tmp_path / "c"))
    last = jobs.read_stop_reasons(spark, out)
    batch = ledger.first_failure(fixtures.attempts(spark, sf), order="ts_us").filter("stop_reason IS NOT NULL")
    same(last.select("run_id", "ts_us", "reason"), batch.selectExpr("run_id", "stopped_at AS ts_us", "stop_reason AS reason"))


def test_fetches(spark, sf, events, tmp_path):
    out = str(tmp_path / "out")
    shaped = lambda df: df.select(
        F.col("user_id").alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("fetched_us"), F.col("event_id").cast("string").alias("body"),
        (F.col("event_type") != "error").alias("ok"),
    )
    jobs.latest_fetches(shaped(stream(spark, events)), out, str(tmp_path / "c"))
    last = jobs.read_fetches(spark, out)
    batch = shaped(table(spark, sf, "events")).filter("ok").groupBy("url").agg(
        F.max("fetched_us").alias("fetched_us"), F.max_by("body", "fetched_us").alias("body")
    )
    same(last.select("url", "fetched_us", "body"), batch)


def test_ingestion_is_exactly_once_and_repeatable(spark, sf, tmp_path):
    rows = storage.store_rows(spark, sf)
    drop, root = str(tmp_path / "drop"), str(tmp_path / "store")
    files.store_lines(rows.limit(30)).write.text(f"{drop}/a")
    jobs.ingest_drop_folder(spark, f"{drop}/*", root, str(tmp_path / "c"))
    before = store.latest_version(spark, root)
    jobs.ingest_drop_folder(spark, f"{drop}/*", root, str(tmp_path / "c"))
    assert store.latest_version(spark, root) == before  # nothing new, nothing taken
    files.store_lines(rows).unionByName(spark.createDataFrame([('{"key": "torn',)], "value string")).write.text(f"{drop}/b")
    jobs.ingest_drop_folder(spark, f"{drop}/*", root, str(tmp_path / "c"))
    same(store.read_snapshot(spark, root).select("key", "category", "text"), rows.select("key", "category", "text"))
    assert [r.reason for r in spark.read.parquet(f"{root}/rejected").collect()] == ["not valid JSON"]


def test_latency_windows_keep_one_sketch_each(spark, tmp_path):
    """State has a row per open window and type; late rows change nothing; percentiles are near."""
    folder = str(tmp_path / "in")
    schema = "ts timestamp, event_type string, value double"
    first = "timestamp'2024-01-01 00:00:00'"
    on_time = spark.range(20_000).selectExpr(
        f"timestampadd(SECOND, CAST(id % 7200 AS INT), {first}) AS ts", "CASE WHEN id % 10 = 0 THEN 'error' ELSE 'view' END AS event_type",
        "CAST((id * 7919) % 20000 AS DOUBLE) AS value",
    )
    on_time.coalesce(1).write.mode("append").parquet(folder)
    spark.sql(f"SELECT timestampadd(HOUR, 4, {first}) AS ts, 'view' AS event_type, 1D AS value").write.mode("append").parquet(folder)
    late = spark.sql(f"SELECT {first} AS ts, 'error' AS event_type, 1e9D AS value")
    late.write.mode("append").parquet(folder)
    spark.sql(f"SELECT timestampadd(HOUR, 6, {first}) AS ts, 'view' AS event_type, 1D AS value").write.mode("append").parquet(folder)
    out, checkpoint = jobs.stream_paths(spark, "sketches")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    progress = jobs.latency_sketches(rows, out, checkpoint, "1 hour", "10 minutes")
    held = [state["numRowsTotal"] for p in progress for state in p["stateOperators"]]
    assert max(held) <= 2 * 2 + 1  # two types in two windows, and the newest window
    dropped = sum(state["numRowsDroppedByWatermark"] for p in progress for state in p["stateOperators"])
    assert dropped == 1
    found = jobs.read_latency_windows(spark, out, "error").orderBy("window_start").collect()
    # the two hours of on-time rows and the fourth hour are final, the sixth is still open
    assert [(r.requests, r.errors) for r in found] == [(n, e) for n, e in _hourly(20_000)] + [(1, 0)]
    values = [[(i * 7919) % 20000 for i in range(20_000) if i % 7200 // 3600 == hour] for hour in (0, 1)]
    for r, own in zip(found, values):
        below, through = sum(v < r.p95 for v in own), sum(v <= r.p95 for v in own)
        slack = 4 * metrics.rank_error() * len(own) + 1
        assert below <= 0.95 * len(own) + slack and through >= 0.95 * len(own) - slack


def test_latency_windows_give_the_exact_percentile(spark, sf):
    """The query answers with the percentile itself, as linearly interpolated between the rows of a window."""
    from docloom.plans.streams import latency_windows

    found = {r.window_start: r.p95 for r in latency_windows(spark, sf).collect()}
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600
    rows = spark.read.parquet(f"{sf}/events.parquet").groupBy(hour.alias("w")).agg(F.percentile("value", 0.95).alias("p95"))
    expected = {r.w: r.p95 for r in rows.collect()}
    assert found and all(abs(p95 - expected[w]) < 1e-8 for w, p95 in found.items())


def _hourly(n):
    for hour in (0, 1):
        rows = [i for i in range(n) if i % 7200 // 3600 == hour]
        yield len(rows), sum(i % 10 == 0 for i in rows)


def test_sketches_merge_upwards(spark):
    """Sketches of small groups, merged twice, stay within the rank error of all rows together."""
    rows = spark.range(30_000).selectExpr("id % 30 AS cell", "id % 3 AS mode", "CAST((id * 48271) % 30011 AS DOUBLE) AS v")
    odd = spark.createDataFrame([(0, 0, None), (0, 0, float("nan"))], "cell long, mode long, v double")
    stored = metrics.stored_sketches(rows.unionByName(odd), ["mode", "cell"], F.col("v"))
    merged = metrics.merged_sketches(metrics.merged_sketches(stored, ["mode"]), [])
    found = metrics.sketched_summary(merged, []).first()
    values = sorted((i * 48271) % 30011 for i in range(30_000))
    assert found.n == 30_000 and found["max"] == values[-1] and abs(found["mean"] - sum(values) / 30_000) < 1e-6
    for name, p in metrics.SUMMARY_PROBS.items():
        rank = sum(v <= found[name] for v in values)
        assert abs(rank - p * 30_000) <= 4 * metrics.rank_error() * 30_000 + 1

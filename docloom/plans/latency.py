"""Latency, throughput and rate-limit summaries of samples made from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import metrics
from docloom.plans import fixtures
from docloom.plans.registry import query, table
from docloom.session import cut, scratch_path
from docloom.sources import files

CELL = ["mode", "concurrency", "repeat"]


def _rounded(df, *columns):
    for column in columns:
        df = df.withColumn(column, F.round(column, 11))
    return df


@query("b14_keep_headers", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'RateLimit-' || event_type || '=' || json_extract_string(props, '$.k') ELSE '' END
       || '|' || CASE WHEN event_id % 3 = 0 THEN 'Retry-After=' || event_id ELSE '' END AS kept FROM events""")
def keep_headers(spark, sf_dir):
    number = F.col("event_id")
    limit = F.when(number % 2 == 0, F.concat(F.lit("RateLimit-"), "event_type")).otherwise("Date")
    other = F.when(number % 3 == 0, "Retry-After").otherwise("Server")
    headers = F.create_map(limit, F.get_json_object("props", "$.k"), other, number.cast("string"))
    kept = metrics.keep_headers(headers, ["ratelimit-"], ["retry-after"])
    name = F.concat(F.lit("RateLimit-"), F.col("event_type"))
    shown = F.concat(
        F.coalesce(F.concat(name, F.lit("="), F.try_element_at("kept", name)), F.lit("")), F.lit("|"),
        F.coalesce(F.concat(F.lit("Retry-After="), F.try_element_at("kept", F.lit("Retry-After"))), F.lit("")),
    )
    return table(spark, sf_dir, "events").withColumn("kept", kept).select("event_id", shown.alias("kept"))


@query("d12_summary", """
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 11) AS p50, round(quantile_cont(value, 0.95), 11) AS p95,
       round(quantile_cont(value, 0.99), 11) AS p99, max(value) AS max, round(avg(value), 11) AS mean FROM events GROUP BY event_type""")
def summary(spark, sf_dir):
    found = metrics.summary(table(spark, sf_dir, "events"), ["event_type"], F.col("value"))
    return _rounded(found, "p50", "p95", "p99", "mean")


@query("d12_summary_overall", """
SELECT count(*) AS n, round(quantile_cont(value, 0.5), 11) AS p50, round(quantile_cont(value, 0.95), 11) AS p95,
       round(quantile_cont(value, 0.99), 11) AS p99, max(value) AS max, round(avg(value), 11) AS mean FROM events""")
def summary_overall(spark, sf_dir):
    return _rounded(metrics.summary(table(spark, sf_dir, "events"), [], F.col("value")), "p50", "p95", "p99", "mean")


_LEVELS = (["event_type", "concurrency", "repeat"], ["event_type", "concurrency"], ["event_type"])


@query("d13_summary_approx", """
WITH e AS (SELECT event_type, user_id % 4 AS concurrency, event_id % 3 AS repeat, value FROM events)
SELECT event_type, concurrency, repeat, count(value) AS n, true AS p50_ok, true AS p95_ok, true AS p99_ok, max(value) AS max, round(avg(value), 9) AS mean
FROM e GROUP BY GROUPING SETS ((event_type, concurrency, repeat), (event_type, concurrency), (event_type))""")
def summary_approx(spark, sf_dir):
    """Sketches stored per repeat, merged to cells and to modes; every quantile is held against its rank error.

    The error is promised for 99 of 100 quantiles, so four times as much is allowed, and one row.
    """
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("concurrency"), (F.col("event_id") % 3).alias("repeat"), "value")
    finest, cell, mode = _LEVELS
    stored = cut(metrics.stored_sketches(events, finest, F.col("value")))
    cells = cut(metrics.merged_sketches(stored, cell))
    levels = zip(_LEVELS, (stored, cells, metrics.merged_sketches(cells, mode)))
    every = None
    for by, sketches in levels:
        found = cut(metrics.sketched_summary(sketches, by))
        counts = [
            F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in metrics.SUMMARY_PROBS
        ] + [F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_through") for p in metrics.SUMMARY_PROBS]
        ranks = events.join(found, by).groupBy(*by, "n", "max", "mean").agg(*counts)
        slack = 4 * metrics.rank_error() * F.col("n") + 1
        checked = ranks.select(
            *(F.col(c) if c in by else F.lit(None).cast("bigint").alias(c) for c in finest), "n",
            *(((F.col(f"{p}_below") <= q * F.col("n") + slack) & (F.col(f"{p}_through") >= q * F.col("n") - slack)).alias(f"{p}_ok")
              for p, q in metrics.SUMMARY_PROBS.items()),
            "max", F.round("mean", 9).alias("mean"),
        )
        every = checked if every is None else every.unionByName(checked)
    return every


_CELLS = "WITH " + fixtures.SAMPLES + """, cells AS (
  SELECT mode, concurrency, repeat, count(*) AS requests, count(error) AS errors, max(t1) - min(t0) AS wall_s,
         (count(*) - count(error)) / (max(t1) - min(t0)) AS throughput, avg(CASE WHEN error IS NULL THEN delay END) AS mean_delay_s,
         count(DISTINCT error) AS n_error_kinds FROM samples GROUP BY ALL),
kinds AS (SELECT mode, concurrency, repeat, string_agg(error, ', ' ORDER BY error) AS error_kinds FROM (
    SELECT mode, concurrency, repeat, error, row_number() OVER (PARTITION BY mode, concurrency, repeat ORDER BY count(*) DESC, error) AS place
    FROM samples WHERE error IS NOT NULL GROUP BY mode, concurrency, repeat, error) WHERE place <= 20 GROUP BY mode, concurrency, repeat),
times AS (SELECT *, (t1 - t0 - (server_send - server_recv)) * 1000 AS overhead_ms, (server_recv - t0) * 1000 AS pre_ms, (t1 - server_send) * 1000 AS post_ms
          FROM samples WHERE error IS NULL)"""


@query("d14_median_range", _CELLS + """
SELECT concurrency, mode, count(*) AS n, round(quantile_cont(throughput, 0.5), 11) AS mid, round(min(throughput), 11) AS low, round(max(throughput), 11) AS high
FROM cells GROUP BY ALL""")
def median_range(spark, sf_dir):
    cells = metrics.cell_metrics(fixtures.samples(spark, sf_dir), CELL)
    return _rounded(metrics.median_range(cells, ["concurrency", "mode"], F.col("throughput")), "mid", "low", "high")


@query("d15_cell_metrics", _CELLS + """
, o AS (SELECT mode, concurrency, repeat, round(quantile_cont(overhead_ms, 0.5), 11) AS overhead_p50, round(quantile_cont(pre_ms, 0.99), 11) AS pre_p99,
        round(quantile_cont(post_ms, 0.99), 11) AS post_p99 FROM times GROUP BY ALL)
SELECT mode, concurrency, repeat, requests, errors, n_error_kinds, coalesce(error_kinds, '') AS error_kinds, wall_s, round(throughput, 11) AS throughput,
       mean_delay_s, overhead_p50, pre_p99, post_p99
FROM cells JOIN o USING (mode, concurrency, repeat) LEFT JOIN kinds USING (mode, concurrency, repeat)""")
def cell_metrics(spark, sf_dir):
    samples = fixtures.samples(spark, sf_dir)
    cells = _rounded(metrics.cell_metrics(samples, CELL), "throughput")
    times = metrics.path_times(samples)
    wanted = {"overhead_p50": ("overhead_ms", 0.5), "pre_p99": ("pre_ms", 0.99), "post_p99": ("post_ms", 0.99)}
    return cells.join(_rounded(metrics.column_quantiles(times, CELL, wanted), *wanted), CELL)


@query("d16_sweep_table", _CELLS + """
, plan AS (SELECT DISTINCT mode, concurrency, r.repeat FROM samples, (VALUES (0), (1), (2), (3)) r(repeat)),
o AS (SELECT mode, concurrency, repeat, quantile_cont(overhead_ms, 0.5) AS p50, quantile_cont(overhead_ms, 0.95) AS p95, quantile_cont(overhead_ms, 0.99) AS p99 FROM times GROUP BY ALL),
g AS (SELECT concurrency, mode, count(*) AS cells, count(c.wall_s) AS completed, CAST(coalesce(sum(c.errors), 0) AS BIGINT) AS errors,
  quantile_cont(throughput, 0.5) AS rate_med, min(throughput) AS rate_min, max(throughput) AS rate_max, quantile_cont(p50, 0.5) AS overhead_p50,
  quantile_cont(p95, 0.5) AS overhead_p95, quantile_cont(p99, 0.5) AS overhead_p99
  FROM plan LEFT JOIN cells c USING (mode, concurrency, repeat) LEFT JOIN o USING (mode, concurrency, repeat) GROUP BY ALL)
SELECT concurrency, mode, CAST(CASE mode WHEN 'threads' THEN 0 WHEN 'asyncio' THEN 1 WHEN 'asyncio-uvloop' THEN 2 WHEN 'raw-asyncio' THEN 3 ELSE 4 END AS BIGINT) AS mode_rank,
  cells, completed, errors, round(rate_med, 11) AS rate_med, round(rate_min, 11) AS rate_min, round(rate_max, 11) AS rate_max,
  round(overhead_p50, 11) AS overhead_p50, round(overhead_p95, 11) AS overhead_p95, round(overhead_p99, 11) AS overhead_p99,
  round(100.0::DOUBLE * rate_med / (2048 / (ceil(2048 / CAST(CASE WHEN mode IN ('threads', 'asyncio', 'asyncio-uvloop') THEN least(concurrency, 1000) ELSE concurrency END AS DOUBLE)) * 0.0625::DOUBLE)), 11) AS pct_ideal
FROM g""")
def sweep_table(spark, sf_dir):
    """Four repeats were planned per cell group and the last never ran."""
    samples = fixtures.samples(spark, sf_dir)
    repeats = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("repeat")
    grid = samples.select("mode", "concurrency").distinct().select("mode", "concurrency", repeats)
    grid = grid.select("*", F.lit(2048).alias("planned"), F.lit(0.0625).alias("latency_s"), F.lit(0.0).alias("jitter"))
    found = metrics.sweep_table(grid, samples, CELL).drop("planned", "latency_s", "jitter")
    return _rounded(found, "rate_med", "rate_min", "rate_max", "overhead_p50", "overhead_p95", "overhead_p99", "pct_ideal")


@query("d17_worst_health", _CELLS + """
SELECT scenario, count(*) AS cells, max(lag) AS worst_lag, max(late) AS worst_late
FROM (SELECT scenario, user_id, max(t1 - t0) AS lag, max(server_recv - t0) AS late FROM samples GROUP BY ALL) GROUP BY scenario""")
def worst_health(spark, sf_dir):
    cells = fixtures.samples(spark, sf_dir).groupBy("scenario", "user_id").agg(
        F.max(F.col("t1") - F.col("t0")).alias("lag"), F.max(F.col("server_recv") - F.col("t0")).alias("late")
    )
    return metrics.worst_health(cells, "scenario", ["lag", "late"])


@query("d18_outcome_counts", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
       count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup,
       count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def outcome_counts(spark, sf_dir):
    return metrics.outcome_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


_HEADROOM = """heads AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'requests' WHEN 1 THEN 'input-tokens' ELSE 'output-tokens' END AS kind,
  CAST(100 + event_id % 50 AS DOUBLE) AS lim, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS remaining FROM events)"""


def _headers():
    number = F.col("event_id")
    kind = F.when(number % 3 == 0, "requests").when(number % 3 == 1, "input-tokens").otherwise("output-tokens")
    name = lambda which: F.concat(F.lit("ratelimit-"), kind, F.lit(which))
    remaining = F.when(number % 7 == 0, "soon").otherwise(F.get_json_object("props", "$.k"))
    return F.create_map(
        name("-limit"), (number % 50 + 100).cast("string"), name("-remaining"), remaining,
        name("-reset"), F.lit("17"), F.lit("date"), F.lit("9"),
    )


@query("d19_min_headroom", "WITH " + _HEADROOM + """
SELECT user_id, kind, max(lim) AS max_limit, min(remaining) AS min_remaining, round(min(remaining) / max(lim), 9) AS headroom
FROM heads GROUP BY user_id, kind""")
def min_headroom(spark, sf_dir):
    found = metrics.min_headroom(table(spark, sf_dir, "events"), ["user_id"], _headers())
    return found.withColumn("headroom", F.round("headroom", 9))


@query("d25_cancel_metrics", """
WITH e AS (SELECT user_id AS run_id, event_type, event_id / 8.0::DOUBLE AS t FROM events),
f AS (SELECT run_id, min(t) FILTER (event_type = 'error') AS cancel, min(t) FILTER (event_type = 'signup') AS regain_at,
             max(t) FILTER (event_type = 'purchase') AS close_at FROM e GROUP BY run_id)
SELECT run_id, cancel, regain_at - cancel AS regain, close_at - cancel AS closed,
       CASE WHEN cancel IS NOT NULL THEN (SELECT count(*) FROM e WHERE e.run_id = f.run_id AND event_type = 'click' AND t > f.cancel) END AS replies_after
FROM f""")
def cancel_metrics(spark, sf_dir):
    kind = F.col("event_type")
    event = F.when(kind == "error", "cancel").when(kind == "signup", "regain").when(kind == "purchase", "close").when(kind == "click", "reply").otherwise("send")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), event.alias("event"), (F.col("event_id") / F.lit(8.0)).alias("t")
    )
    return metrics.cancel_metrics(events)


@query("d27_overhead_split", _CELLS + """
, o AS (SELECT mode, concurrency, repeat, quantile_cont(pre_ms, 0.5) AS a, quantile_cont(pre_ms, 0.99) AS b, quantile_cont(post_ms, 0.5) AS c, quantile_cont(post_ms, 0.99) AS d
        FROM times GROUP BY ALL)
SELECT concurrency, mode, round(quantile_cont(a, 0.5), 11) AS pre_p50, round(quantile_cont(b, 0.5), 11) AS pre_p99,
       round(quantile_cont(c, 0.5), 11) AS post_p50, round(quantile_cont(d, 0.5), 11) AS post_p99 FROM o GROUP BY ALL""")
def overhead_split(spark, sf_dir):
    return _rounded(metrics.overhead_split(fixtures.samples(spark, sf_dir), CELL), "pre_p50", "pre_p99", "post_p50", "post_p99")


@query("d28_size_table", _CELLS + """
, sized AS (SELECT *, CASE repeat WHEN 0 THEN 'large' WHEN 1 THEN 'tiny' ELSE 'classifier-like' END AS size, user_id % 4 AS part FROM samples),
c AS (SELECT size, concurrency, mode, part, count(error) AS errors, (count(*) - count(error)) / (max(t1) - min(t0)) AS throughput FROM sized GROUP BY ALL),
o AS (SELECT size, concurrency, mode, part, quantile_cont((t1 - t0 - (server_send - server_recv)) * 1000, 0.5) AS p50,
        quantile_cont((t1 - t0 - (server_send - server_recv)) * 1000, 0.99) AS p99 FROM sized WHERE error IS NULL GROUP BY ALL),
g AS (SELECT size, concurrency, mode, quantile_cont(throughput, 0.5) AS rate_med, min(throughput) AS rate_min, max(throughput) AS rate_max, CAST(sum(errors) AS BIGINT) AS errors FROM c GROUP BY ALL),
h AS (SELECT size, concurrency, mode, quantile_cont(p50, 0.5) AS overhead_p50, quantile_cont(p99, 0.5) AS overhead_p99 FROM o GROUP BY ALL)
SELECT size, concurrency, mode, CAST(CASE size WHEN 'tiny' THEN 0 WHEN 'classifier-like' THEN 1 ELSE 2 END AS BIGINT) AS size_rank, errors,
       round(rate_med, 11) AS rate_med, round(rate_min, 11) AS rate_min, round(rate_max, 11) AS rate_max, round(overhead_p50, 11) AS overhead_p50, round(overhead_p99, 11) AS overhead_p99
FROM g JOIN h USING (size, concurrency, mode)""")
def size_table(spark, sf_dir):
    repeat = F.col("repeat")
    size = F.when(repeat == 0, "large").when(repeat == 1, "tiny").otherwise("classifier-like")
    samples = fixtures.samples(spark, sf_dir).withColumn("size", size).withColumn("part", F.col("user_id") % 4)
    cell = ["size", "concurrency", "mode", "part"]
    overhead = metrics.quantiles(metrics.path_times(samples), cell, F.col("overhead_ms"), {"p50": 0.5, "p99": 0.99})
    found = metrics.size_table(metrics.cell_metrics(samples, cell), overhead)
    return _rounded(found, "rate_med", "rate_min", "rate_max", "overhead_p50", "overhead_p99")


@query("d32_run_tables", "WITH " + fixtures.SAMPLES + ", " + _HEADROOM + """
, s AS (SELECT user_id, t0, t1, CASE WHEN scenario <> 'error' THEN 'ok' WHEN event_id % 2 = 0 THEN 'http_429' ELSE 'timeout' END AS outcome,
  CASE WHEN event_id % 4 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop, event_id % 997 AS tin, event_id % 101 AS tout, event_id % 4 <> 0 AS valid FROM samples),
r AS (SELECT user_id, count(*) AS requests, max(t1) - min(t0) AS wall_s, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'http_429') AS rejected,
  count(*) FILTER (outcome <> 'ok') AS not_ok, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens,
  count(*) FILTER (outcome = 'ok' AND valid) AS valid_replies, round(quantile_cont(t1 - t0, 0.5) FILTER (outcome = 'ok'), 13) AS p50,
  round(quantile_cont(t1 - t0, 0.95) FILTER (outcome = 'ok'), 13) AS p95, max(t1 - t0) FILTER (outcome = 'ok') AS max FROM s GROUP BY user_id),
h AS (SELECT user_id, round(min(room), 9) AS lowest_headroom FROM (SELECT user_id, kind, min(remaining) / max(lim) AS room FROM heads GROUP BY ALL) GROUP BY user_id),
t AS (SELECT user_id, count(*) AS n_stop_reasons, string_agg(stop || ': ' || n, ', ' ORDER BY stop) AS stop_reasons FROM (SELECT user_id, stop, count(*) AS n FROM s WHERE outcome = 'ok' GROUP BY ALL) GROUP BY user_id)
SELECT user_id, requests, wall_s, ok, rejected, not_ok, input_tokens, output_tokens, valid_replies, round(ok / wall_s, 11) AS rate,
  round((input_tokens * 2.0::DOUBLE + output_tokens * 10.0::DOUBLE) / 1e6::DOUBLE, 11) AS cost_usd, p50, p95, max, lowest_headroom, n_stop_reasons, stop_reasons
FROM r LEFT JOIN h USING (user_id) LEFT JOIN t USING (user_id)""")
def run_tables(spark, sf_dir):
    number = F.col("event_id")
    failed = F.when(number % 2 == 0, "http_429").otherwise("timeout")
    props = table(spark, sf_dir, "events").select("event_id", "props")
    samples = fixtures.samples(spark, sf_dir).join(props, "event_id").select(
        "user_id", "event_id", "props", "t0", "t1",
        F.when(F.col("scenario") == "error", failed).otherwise("ok").alias("outcome"),
        F.when(number % 4 == 0, "max_tokens").otherwise("end_turn").alias("stop_reason"),
        (number % 997).alias("input_tokens"), (number % 101).alias("output_tokens"), (number % 4 != 0).alias("valid_reply"),
    )
    found = metrics.run_tables(samples, ["user_id"], _headers())
    found = _rounded(found, "rate", "cost_usd").withColumn("lowest_headroom", F.round("lowest_headroom", 9))
    return found.withColumn("p50", F.round("p50", 13)).withColumn("p95", F.round("p95", 13))


@query("d33_error_kinds", "WITH " + fixtures.SAMPLES + r"""
, k AS (SELECT mode, concurrency, regexp_replace(error, '[\w.]+\.(\w+)', '\1', 'g') AS kind, count(*) AS n FROM samples WHERE error IS NOT NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY mode, concurrency ORDER BY n DESC, kind) AS place FROM k),
t AS (SELECT mode, concurrency, count(*) AS n_kinds, string_agg(kind, ', ' ORDER BY kind) FILTER (place <= 20) AS kinds FROM p GROUP BY ALL)
SELECT mode, concurrency, count(error) AS errors, coalesce(any_value(n_kinds), 0) AS n_kinds,
       CASE WHEN count(error) > 0 THEN count(error) || ' ' || any_value(kinds) ELSE '0' END AS kinds
FROM samples LEFT JOIN t USING (mode, concurrency) GROUP BY mode, concurrency""")
def error_kinds(spark, sf_dir):
    return metrics.error_kinds(fixtures.samples(spark, sf_dir), ["mode", "concurrency"])


@query("d33_counted_kinds", "WITH " + fixtures.SAMPLES + """
SELECT mode, user_id AS kind, count(*) AS n, row_number() OVER (PARTITION BY mode ORDER BY count(*) DESC, user_id) AS place FROM samples GROUP BY mode, user_id""")
def counted_kinds(spark, sf_dir):
    """All kinds of a group as rows; here a mode's users."""
    return metrics.counted_kinds(fixtures.samples(spark, sf_dir), ["mode"], F.col("user_id"))


@query("e11_stall_outliers", "WITH " + fixtures.SAMPLES + """
, c AS (SELECT mode, user_id, count(*) / (max(t1) - min(t0)) AS rate FROM samples GROUP BY ALL),
m AS (SELECT mode, quantile_cont(rate, 0.5) AS group_median FROM c GROUP BY mode)
SELECT mode, user_id, round(rate, 11) AS rate, round(group_median, 11) AS group_median FROM c JOIN m USING (mode) WHERE rate < 0.9::DOUBLE * group_median""")
def stall_outliers(spark, sf_dir):
    cells = fixtures.samples(spark, sf_dir).groupBy("mode", "user_id").agg(
        (F.count(F.lit(1)) / (F.max("t1") - F.min("t0"))).alias("rate")
    )
    return _rounded(metrics.stall_outliers(cells, ["mode"], "rate", share=0.9), "rate", "group_median")


@query("a15_scan_cells", "WITH " + fixtures.SAMPLES + """
, filed AS (SELECT *, event_id // 32 AS file FROM samples)
SELECT CAST(file AS VARCHAR) AS scenario, t0, t1, error, true AS completed FROM filed WHERE file % 10 <> 0
UNION ALL SELECT DISTINCT CAST(file AS VARCHAR), NULL, NULL, NULL, false FROM filed WHERE file % 10 = 0""")
def scan_cells(spark, sf_dir):
    """Cell files of 32 samples each; every tenth run left no results."""
    samples = fixtures.samples(spark, sf_dir).withColumn("file", F.floor(F.col("event_id") / 32))
    row = F.struct("t0", "t1", "server_recv", "server_send", "delay", "error")
    cells = samples.groupBy("file").agg(F.sort_array(F.collect_list(row)).alias("r"), F.max("t1").alias("end"))
    arrays = F.struct(*[F.col(f"r.{n}").alias(n) for n in ("t0", "t1", "server_recv", "server_send", "delay", "error")])
    worker = F.when(F.col("file") % 10 != 0, F.struct(F.col("end").alias("wall_s"), arrays.alias("samples")))
    path = scratch_path(spark, "cells")
    cell = F.struct(F.col("file").cast("string").alias("scenario"))
    cells.select(F.to_json(F.struct(cell.alias("cell"), worker.alias("worker")), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    # Written one cell per line, so that few files are needed.
    found = files.cells_from(spark.read.schema(files.CELL_SCHEMA).json(path))
    return found.select("scenario", "t0", "t1", "error", "completed")

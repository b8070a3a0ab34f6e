"""Latency and throughput summaries of request samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.costs import cost_usd, ideal_throughput
from docloom.functions.text import short_error
from docloom.operators.ordered import match_keys, quantiles, sorted_ordinal, top_k
from docloom.operators.sets import position_in

# Display order of modes and size classes; modes with a pooled client.
MODE_ORDER = ["threads", "asyncio", "asyncio-uvloop", "raw-asyncio"]
SIZE_ORDER = ["tiny", "classifier-like", "large"]
POOLED_MODES = ("threads", "asyncio", "asyncio-uvloop")
SUMMARY_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
# Size of a quantile sketch; see rank_error.
SKETCH_K = 2000
# Kinds named in one text; beside it stands how many there are.
KINDS_SHOWN = 20


def column_quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles of several columns in one pass: ``{output: (column, probability)}``."""
    columns = sorted({column for column, _ in wanted.values()})
    probs = {f"q{i}": p for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    names = {p: name for name, p in probs.items()}
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.explode(pairs).alias("_m")).select(*by, "_m.metric", "_m.v")
    found = quantiles(long, [*by, "metric"], F.col("v"), probs)
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == column, F.col(names[p]))).alias(out) for out, (column, p) in wanted.items()]
    )


def summary(df: DataFrame, by: Sequence[str], value: Column, probs: dict[str, float] | None = None) -> DataFrame:
    """Count, exact percentiles, maximum and mean per group."""
    probs = probs or SUMMARY_PROBS
    ranks = quantiles(df, by, value, probs)
    plain = df.filter(value.isNotNull() & ~F.isnan(value))
    plain = plain.groupBy(*by).agg(F.max(value).alias("max"), F.avg(value).alias("mean"))
    return match_keys(ranks, plain, list(by))


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the rows by which a sketch's quantile may be off in rank, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def stored_sketches(df: DataFrame, by: Sequence[str], value: Column, k: int = SKETCH_K) -> DataFrame:
    """Per group: count, sketch, maximum and sum of the finite values; a table to be kept and merged.

    A group's sketch has a bounded size (some ``3 * k`` values), however many rows the group has.
    """
    plain = df.where(value.isNotNull() & ~F.isnan(value)).select(*by, value.cast("double").alias("_v"))
    return plain.groupBy(*by).agg(
        F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", k).alias("sketch"), F.max("_v").alias("max"), F.sum("_v").alias("total")
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored sketches of finer groups merged to those of ``by``; no sample is read again."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"), F.max("max").alias("max"), F.sum("total").alias("total")
    )


def sketch_quantile(sketch: Column | str, prob: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(prob))


def sketched_summary(sketches: DataFrame, by: Sequence[str], probs: dict[str, float] | None = None) -> DataFrame:
    """As :func:`summary` from stored sketches; quantiles within :func:`rank_error`."""
    found = [sketch_quantile("sketch", p).alias(name) for name, p in (probs or SUMMARY_PROBS).items()]
    return sketches.select(*by, "n", *found, "max", (F.col("total") / F.col("n")).alias("mean"))


def summary_approx(df: DataFrame, by: Sequence[str], value: Column, k: int = SKETCH_K) -> DataFrame:
    """As :func:`summary`, from sketches."""
    return sketched_summary(stored_sketches(df, by, value, k), by)


def median_range(cells: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Median, minimum and maximum across repeats; NaN left out."""
    finite = cells.filter(value.isNotNull() & ~F.isnan(value))
    ends = finite.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return match_keys(quantiles(cells, by, value, {"mid": 0.5}), ends, list(by))


def range_text(n: Column, mid: Column, low: Column, high: Column, digits: int = 1) -> Column:
    shape = f"%.{digits}f"
    return (
        F.when(n.isNull() | (n == 0), F.lit("-"))
        .when(n == 1, F.format_string(shape, mid))
        .otherwise(F.format_string(f"{shape} ({shape}-{shape})", mid, low, high))
    )


def cell_metrics(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per cell: requests, errors and their kinds, wall time, throughput, mean delay."""
    ok = F.col("error").isNull()
    kinds = kinds_text(samples.filter(~ok), by, F.col("error"), "error_kinds", "n_error_kinds")
    sums = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~ok).alias("errors"),
        (F.max("t1") - F.min("t0")).alias("wall_s"),
        F.avg(F.when(ok, F.col("delay"))).alias("mean_delay_s"),
    )
    found = match_keys(sums, kinds, list(by), "left")
    return found.fillna({"error_kinds": "", "n_error_kinds": 0}).withColumn(
        "throughput", (F.col("requests") - F.col("errors")) / F.col("wall_s")
    )


def counted_kinds(samples: DataFrame, by: Sequence[str], kind: Column) -> DataFrame:
    """``(…by, kind, n, place)``: every kind of each group, the most frequent first; groups of any size."""
    counts = samples.groupBy(*by, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    placed = sorted_ordinal(counts, [*(F.col(c) for c in by), F.col("n").desc(), F.col("kind")], "_seq")
    first = placed.groupBy(*by).agg(F.min("_seq").alias("_first"))
    return match_keys(placed, first, list(by)).select(*by, "kind", "n", (F.col("_seq") - F.col("_first") + 1).alias("place"))


def kinds_text(
    samples: DataFrame, by: Sequence[str], kind: Column, text: str, total: str, counts: bool = False, shown: int = KINDS_SHOWN
) -> DataFrame:
    """Per group one text of its ``shown`` most frequent kinds in alphabetical order, and the exact number of kinds."""
    kinds = samples.groupBy(*by, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    number = kinds.groupBy(*by).agg(F.count(F.lit(1)).alias(total))
    first = top_k(kinds, by, [F.col("n").desc(), F.col("kind")], shown, "_place")
    named = F.concat("kind", F.lit(": "), F.col("n").cast("string")) if counts else F.col("kind")
    # at most ``shown`` rows of a group
    listed = first.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(named)), ", ").alias(text))
    return match_keys(number, listed, list(by))


def path_times(samples: DataFrame) -> DataFrame:
    """Successful samples with client overhead, request path and response path in ms."""
    return samples.filter(F.col("error").isNull()).select(
        "*",
        ((F.col("t1") - F.col("t0") - (F.col("server_send") - F.col("server_recv"))) * 1000).alias("overhead_ms"),
        ((F.col("server_recv") - F.col("t0")) * 1000).alias("pre_ms"),
        ((F.col("t1") - F.col("server_send")) * 1000).alias("post_ms"),
    )


def sweep_table(cells: DataFrame, samples: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Throughput, share of the ideal and overhead medians per (concurrency, mode).

    ``cells`` is the grid that was to run (requests, latency_s, jitter, completed); cells
    without samples count as failed, and a group with only failed cells is kept.
    """
    group = ["concurrency", "mode"]
    measured = match_keys(cells, cell_metrics(samples, cell), list(cell), "left").withColumn(
        "completed", F.col("wall_s").isNotNull()
    )
    grid = measured.groupBy(*group).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("completed").alias("completed"),
        F.sum(F.coalesce("errors", F.lit(0))).alias("errors"),
        F.max("planned").alias("planned"),
        F.max("latency_s").alias("latency_s"),
        F.max("jitter").alias("jitter"),
    )
    rate = median_range(measured, group, F.col("throughput")).select(
        *group, F.col("mid").alias("rate_med"), F.col("low").alias("rate_min"), F.col("high").alias("rate_max")
    )
    over = quantiles(path_times(samples), cell, F.col("overhead_ms"), SUMMARY_PROBS)
    table = match_keys(grid, rate, group, "left")
    middle = column_quantiles(over, group, {f"overhead_{n}": (n, 0.5) for n in SUMMARY_PROBS})
    table = match_keys(table, middle, group, "left")
    ideal = ideal_throughput(
        F.col("planned"), F.col("concurrency"), F.col("latency_s"), F.col("jitter"), F.col("mode").isin(*POOLED_MODES)
    )
    return table.withColumn("pct_ideal", F.lit(100.0) * F.col("rate_med") / ideal).withColumn(
        "mode_rank", position_in(F.col("mode"), MODE_ORDER)
    )


def overhead_split(samples: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Medians over cells of p50 and p99 of the request path and the response path."""
    group = ["concurrency", "mode"]
    ends = {f"{path}_{name}": (f"{path}_ms", p) for path in ("pre", "post") for name, p in (("p50", 0.5), ("p99", 0.99))}
    per_cell = column_quantiles(path_times(samples), cell, ends)
    return column_quantiles(per_cell, group, {name: (name, 0.5) for name in ends})


def size_table(cells: DataFrame, overhead: DataFrame) -> DataFrame:
    """Per size class, concurrency and mode: throughput range, overhead medians, error sum."""
    group = ["size", "concurrency", "mode"]
    rate = median_range(cells, group, F.col("throughput")).select(
        *group, F.col("mid").alias("rate_med"), F.col("low").alias("rate_min"), F.col("high").alias("rate_max")
    )
    errors = cells.groupBy(*group).agg(F.sum("errors").alias("errors"))
    middle = column_quantiles(overhead, group, {"overhead_p50": ("p50", 0.5), "overhead_p99": ("p99", 0.5)})
    return match_keys(match_keys(rate, errors, group), middle, group).withColumn("size_rank", position_in(F.col("size"), SIZE_ORDER))


def worst_health(cells: DataFrame, by: str, values: list[str]) -> DataFrame:
    return cells.groupBy(by).agg(F.count(F.lit(1)).alias("cells"), *[F.max(v).alias(f"worst_{v}") for v in values])


def outcome_counts(samples: DataFrame, by: str, outcome: str, values: list[str]) -> DataFrame:
    """Histogram of outcomes per run as columns."""
    return samples.groupBy(by).pivot(outcome, values).agg(F.count(F.lit(1))).na.fill(0)


def min_headroom(samples: DataFrame, by: Sequence[str], headers: Column, prefix: str = "ratelimit-") -> DataFrame:
    """Per limit kind: largest limit, smallest remaining, and their ratio."""
    pairs = samples.select(*by, F.explode(headers).alias("name", "raw"))
    pattern = rf"^{prefix}(.+)-([^-]+)$"
    parts = pairs.filter(F.startswith("name", F.lit(prefix)) & ~F.endswith("name", F.lit("-reset"))).select(
        *by,
        F.regexp_extract("name", pattern, 1).alias("kind"),
        F.regexp_extract("name", pattern, 2).alias("which"),
        F.col("raw").try_cast("double").alias("number"),
    ).filter(F.col("number").isNotNull())
    sums = parts.groupBy(*by, "kind").agg(
        F.coalesce(F.max(F.when(F.col("which") == "limit", F.col("number"))), F.lit(0.0)).alias("max_limit"),
        F.min(F.when(F.col("which") == "remaining", F.col("number"))).alias("min_remaining"),
    )
    return sums.withColumn("headroom", F.when(F.col("max_limit") > 0, F.col("min_remaining") / F.col("max_limit")))


def keep_headers(headers: Column, prefixes: list[str], names: list[str]) -> Column:
    """Entries whose lower-case key has one of the prefixes or is one of the names."""
    def kept(key: Column, _value: Column) -> Column:
        low = F.lower(key)
        wanted = low.isin(*names) if names else F.lit(False)
        for prefix in prefixes:
            wanted = wanted | F.startswith(low, F.lit(prefix))
        return wanted

    return F.map_filter(headers, kept)


def error_kinds(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total errors, how many kinds, and the most frequent shortened ones, ``0`` when there is none."""
    totals = samples.groupBy(*by).agg(F.count("error").alias("errors"))
    failed = samples.filter(F.col("error").isNotNull())
    lists = kinds_text(failed, by, short_error(F.col("error")), "_kinds", "n_kinds")
    text = F.concat(F.col("errors").cast("string"), F.lit(" "), F.col("_kinds"))
    return match_keys(totals, lists, list(by), "left").select(
        *by, "errors", F.coalesce("n_kinds", F.lit(0)).cast("bigint").alias("n_kinds"),
        F.when(F.col("errors") > 0, text).otherwise(F.lit("0")).alias("kinds"),
    )


def cancel_metrics(events: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run: first time of each event, and what happened after the cancel request.

    ``events``: (run_id, event, t). Runs without a cancel are kept with nulls.
    """
    def first(name: str) -> Column:
        return F.min(F.when(F.col("event") == name, F.col("t")))

    firsts = events.groupBy(by).agg(
        first("cancel").alias("cancel"), first("regain").alias("regain_at"),
        F.max(F.when(F.col("event") == "close", F.col("t"))).alias("_close"),
    )
    after = events.join(firsts.select(by, "cancel"), by).groupBy(by).agg(
        F.count_if((F.col("event") == "reply") & (F.col("t") > F.col("cancel"))).alias("replies_after")
    )
    has = F.col("cancel").isNotNull()
    return firsts.join(after, by).select(
        by,
        "cancel",
        (F.col("regain_at") - F.col("cancel")).alias("regain"),
        (F.col("_close") - F.col("cancel")).alias("closed"),
        F.when(has, F.col("replies_after")).alias("replies_after"),
    )


def stall_outliers(cells: DataFrame, by: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """Cells whose value is below ``share`` of their group's median."""
    mids = quantiles(cells, by, F.col(value), {"group_median": 0.5}).drop("n")
    return match_keys(cells, mids, list(by)).filter(F.col(value) < F.lit(share) * F.col("group_median"))


def run_tables(samples: DataFrame, by: Sequence[str], headers: Column) -> DataFrame:
    """One line per run: wall time, rate, latency, rejections, headroom, tokens, replies.

    ``samples``: (…by, t0, t1, outcome, stop_reason, input_tokens, output_tokens, valid_reply).
    """
    good = F.col("outcome") == "ok"
    sums = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.max("t1") - F.min("t0")).alias("wall_s"),
        F.count_if(good).alias("ok"),
        F.count_if(F.col("outcome") == "http_429").alias("rejected"),
        F.count_if(~good).alias("not_ok"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if(good & F.col("valid_reply")).alias("valid_replies"),
    ).withColumn("rate", F.col("ok") / F.col("wall_s")).withColumn(
        "cost_usd", cost_usd(F.col("input_tokens"), F.col("output_tokens"))
    )
    latency = summary(samples.filter(good), by, F.col("t1") - F.col("t0"), {"p50": 0.5, "p95": 0.95}).select(
        *by, "p50", "p95", "max"
    )
    # Limit kinds are few per run: their lowest share becomes one text.
    room = min_headroom(samples, by, headers).groupBy(*by).agg(F.min("headroom").alias("lowest_headroom"))
    listed = kinds_text(samples.filter(good), by, F.col("stop_reason"), "stop_reasons", "n_stop_reasons", counts=True)
    for part in (latency, room, listed):
        sums = match_keys(sums, part, list(by), "left")
    return sums

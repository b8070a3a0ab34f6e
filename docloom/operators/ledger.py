"""Requests, replies, attempts, reservations and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.costs import (
    BATCH_SIZE,
    MAX_IN_FLIGHT,
    REQUESTS_PER_BATCH,
    RUN_COST_LIMIT_USD,
    SPARE_OUTPUTS,
    SPARE_REQUESTS,
    UNBILLED_STATUSES,
    cost_usd,
    input_bound,
    max_tokens_for,
)
from docloom.operators.ordered import TEXT_WIDTH, WIDTH, chunk_of, running_totals, sorted_ordinal, with_ordinal

# How a failed attempt is accounted.
FAILURES = (
    # outcome, retryable, possibly billed
    ("connect", True, False),
    ("pool", True, False),
    ("timeout", True, True),
    ("dropped", True, True),
    ("status", None, False),
    ("other", False, True),
)


# -- replies -------------------------------------------------------------------


def reply_check(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Per batch: ids missing, unknown and duplicated in its reply, and whether it is valid.

    ``requests``: (batch_id, id); ``replies``: (batch_id, id, ok).
    """
    sent = requests.select("batch_id", "id").distinct().withColumn("_sent", F.lit(1))
    got = replies.groupBy("batch_id", "id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("ok").alias("_ok"))
    both = sent.join(got, ["batch_id", "id"], "full_outer")
    missing = F.col("_n").isNull()
    unknown = F.col("_sent").isNull()
    double = ~missing & ~unknown & (F.col("_n") > 1)
    per = both.groupBy("batch_id").agg(
        F.count_if(missing).alias("n_missing"),
        F.count_if(unknown).alias("n_unknown"),
        F.count_if(double).alias("n_duplicate"),
        F.count_if(~missing & ~F.coalesce("_ok", F.lit(False))).alias("n_bad_fields"),
    )
    return per.withColumn(
        "valid",
        (F.col("n_missing") == 0) & (F.col("n_unknown") == 0) & (F.col("n_duplicate") == 0) & (F.col("n_bad_fields") == 0),
    )


def diagnose_reply(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Every id that is wrong in a reply and how, one row each."""
    sent = requests.select("batch_id", "id").distinct().withColumn("_sent", F.lit(1))
    got = replies.groupBy("batch_id", "id").agg(F.count(F.lit(1)).alias("_n"))
    problem = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("_sent").isNull(), "unknown")
        .when(F.col("_n") > 1, "duplicate")
    )
    return sent.join(got, ["batch_id", "id"], "full_outer").select("batch_id", "id", problem.alias("problem")).filter(
        "problem is not null"
    )


def zip_reply(requests: DataFrame, replies: DataFrame) -> DataFrame:
    return requests.join(replies, ["batch_id", "id"])


def failure_class(outcome: Column, status: Column) -> Column:
    """``struct(retryable, possibly_billed)`` of a failed attempt."""
    from docloom.functions.costs import is_retryable

    retry = F.when(outcome == "status", is_retryable(status, F.lit(None).cast("string")))
    billed = F.lit(None).cast("boolean")
    for name, retryable, possibly in FAILURES:
        if retryable is not None:
            retry = F.when(outcome == name, F.lit(retryable)).otherwise(retry)
        billed = F.when(outcome == name, F.lit(possibly)).otherwise(billed)
    return F.struct(retry.alias("retryable"), billed.alias("possibly_billed"))


# -- batches and caps ----------------------------------------------------------


def number_batches(pending: DataFrame, order: str, size: int = BATCH_SIZE) -> DataFrame:
    """Batch number and place in the batch of every pending item, by a unique whole-number order."""
    numbered = with_ordinal(pending, [], order, "_seq", TEXT_WIDTH)
    return numbered.select(
        *pending.columns,
        F.expr(f"(_seq - 1) div {size}").alias("batch_id"),
        F.expr(f"(_seq - 1) % {size}").alias("place"),
    )


def batch_payload_sizes(batched: DataFrame, payload: Column) -> DataFrame:
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length(payload)).alias("bytes")
    )


def build_payloads(batched: DataFrame, text: Column) -> DataFrame:
    """One JSON request per batch (a batch holds at most its fixed number of items)."""
    item = F.struct(F.concat(F.lit("e"), F.col("place").cast("string")).alias("id"), text.alias("text"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"])
    return batched.groupBy("batch_id").agg(F.to_json(F.struct(items.alias("items"))).alias("payload"))


def plan_caps(batches: DataFrame, max_cost: float = RUN_COST_LIMIT_USD) -> DataFrame:
    """Hard caps of one run over ``batches`` (entries, bytes), and whether it may start."""
    sums = batches.select("entries", input_bound(F.col("bytes")).alias("bound")).agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("entries").alias("entries"),
        F.sum("bound").alias("_sum"),
        F.max("bound").alias("_max"),
    )
    capped = sums.select(
        "batches",
        "entries",
        (F.lit(REQUESTS_PER_BATCH) * F.col("batches") + SPARE_REQUESTS).alias("max_requests"),
        (
            (F.least(F.lit(MAX_IN_FLIGHT), F.col("batches")) + SPARE_OUTPUTS) * max_tokens_for(F.lit(BATCH_SIZE))
            + F.lit(128) * F.col("entries")
        ).alias("max_output"),
        (
            F.col("_sum") + (F.lit(REQUESTS_PER_BATCH) * F.col("batches") + SPARE_REQUESTS - F.col("batches")) * F.col("_max")
        ).alias("max_input"),
    )
    worst = cost_usd(F.col("max_input"), F.col("max_output"))
    return capped.withColumn("worst_usd", worst).withColumn("refused", worst > max_cost)


# -- attempts ------------------------------------------------------------------


def ledger_usage(attempts: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run: requests, what was billed, what may have been, what is in flight, the cost."""
    def total(state: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("state") == state, F.col(column))), F.lit(0))

    sums = attempts.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        total("billed", "input_tokens").alias("input_tokens"),
        total("billed", "output_tokens").alias("output_tokens"),
        F.count_if(F.col("state") == "cut_off").alias("cut_off_requests"),
        total("cut_off", "input_bound").alias("cut_off_input"),
        total("cut_off", "max_tokens").alias("cut_off_output"),
        F.count_if(F.col("state") == "in_flight").alias("in_flight_requests"),
        total("in_flight", "input_bound").alias("reserved_input"),
        total("in_flight", "max_tokens").alias("reserved_output"),
    )
    return sums.withColumn(
        "cost_usd",
        cost_usd(
            F.col("input_tokens") + F.col("cut_off_input") + F.col("reserved_input"),
            F.col("output_tokens") + F.col("cut_off_output") + F.col("reserved_output"),
        ),
    )


def first_failure(attempts: DataFrame, by: str = "run_id", order: str = "ts") -> DataFrame:
    """First error of each run (null when none); later ones are ignored."""
    failed = F.col("reason").isNotNull()
    return attempts.groupBy(by).agg(
        F.min(F.when(failed, F.struct(order, "reason")))["reason"].alias("stop_reason"),
        F.min(F.when(failed, F.col(order))).alias("stopped_at"),
    )


def requests_in_flight(intervals: DataFrame, by: str = "run_id", width: int = WIDTH) -> DataFrame:
    """Running number of open intervals after every change, ``(by, at_us, in_flight)``.

    Intervals are (start_us, end_us), half-open. Changes at one instant are summed first. They are
    numbered without gaps, so a task holds at most ``width`` changes of a run, however dense.
    """
    deltas = intervals.select(by, F.explode(F.array(
        F.struct(F.col("start_us").alias("at_us"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at_us"), F.lit(-1).alias("d"))
    )).alias("e")).select(by, "e.at_us", "e.d")
    net = deltas.groupBy(by, "at_us").agg(F.sum("d").alias("d"))
    numbered = sorted_ordinal(net, [F.col(by), F.col("at_us")], "_place")
    return running_totals(numbered, [by], "_place", {"in_flight": F.col("d")}, width).drop("d", "_place")


def peak_in_flight(intervals: DataFrame, by: str = "run_id") -> DataFrame:
    return requests_in_flight(intervals, by).groupBy(by).agg(F.max("in_flight").alias("peak"))


def admit_under_caps(
    log: DataFrame,
    max_requests: int,
    max_output: int,
    max_input: int,
    time_limit_s: float,
    by: str = "run_id",
    carried: DataFrame | None = None,
) -> DataFrame:
    """Admit or refuse every attempt of each run, in serial order.

    ``log``: (run_id, serial, ts_us, out_delta, in_delta, is_attempt). An attempt reserves its
    deltas; a settlement row gives back what was not used. An attempt is refused when the
    deadline has passed, the request cap is reached, or its own reservation on top of what is
    committed would pass a cap. The first refusal stops the run.

    ``carried``: (run_id, start_us, requests, out_sum, in_sum, stopped) from earlier input.
    """
    def none_before(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast(kind))

    committed = running_totals(
        log,
        [by],
        "serial",
        {
            "_requests": F.col("is_attempt").cast("bigint"),
            "_out": F.col("out_delta"),
            "_in": F.col("in_delta"),
        },
        inclusive=False,
    )
    starts = log.groupBy(by).agg(F.min("ts_us").alias("_start"))
    rows = committed.join(starts, by)
    if carried is not None:
        rows = rows.join(carried, by, "left").select(
            *committed.columns[: len(log.columns)],
            (F.col("_requests") + none_before("requests", "bigint")).alias("_requests"),
            (F.col("_out") + none_before("out_sum", "bigint")).alias("_out"),
            (F.col("_in") + none_before("in_sum", "bigint")).alias("_in"),
            F.coalesce("start_us", "_start").alias("_start"),
            F.coalesce("stopped", F.lit(False)).alias("_stopped"),
        )
    else:
        rows = rows.withColumn("_stopped", F.lit(False))
    reason = (
        F.when(F.col("_stopped"), "stopped")
        .when(F.col("ts_us") >= F.col("_start") + F.lit(int(time_limit_s * 1_000_000)), "time_limit")
        .when(F.col("_requests") >= max_requests, "max_requests")
        .when(F.col("_out") + F.col("out_delta") > max_output, "max_output")
        .when(F.col("_in") + F.col("in_delta") > max_input, "max_input")
    )
    tested = rows.withColumn("_why", F.when(F.col("is_attempt"), reason))
    refusal = tested.groupBy(by).agg(F.min(F.when(F.col("_why").isNotNull(), F.col("serial"))).alias("_first"))
    return tested.join(refusal, by).select(
        *log.columns,
        F.when(F.col("serial") < F.col("_first"), F.lit(None))
        .when(F.col("serial") == F.col("_first"), F.col("_why"))
        .when(F.col("serial") > F.col("_first"), F.lit("stopped"))
        .alias("refusal"),
    ).withColumn("admitted", F.col("refusal").isNull())


def over_reservation(attempts: DataFrame, by: str = "run_id") -> DataFrame:
    """Responses billed above their reservation, and everything after in the same run."""
    over = (F.col("input_tokens") > F.col("input_bound")) | (F.col("output_tokens") > F.col("max_tokens"))
    billed = attempts.filter(F.col("state") == "billed")
    first = billed.filter(over).groupBy(by).agg(F.min("serial").alias("_first"))
    return attempts.join(first, by).filter(F.col("serial") >= F.col("_first")).select(
        *attempts.columns, (over & (F.col("state") == "billed")).alias("over")
    )


def attempt_numbers(attempts: DataFrame, send: list[str], order: str) -> DataFrame:
    """Number of each attempt within its send."""
    return with_ordinal(attempts, send, order, "attempt")


def unfinished_claims(claims: DataFrame, finishes: DataFrame, by: str, within_us: int) -> DataFrame:
    """Claims (by, ts_us) with no finish of the same owner in ``[ts, ts + within]``.

    Finishes are reduced to their first and last instant per owner and time bucket as wide as
    the limit. A claim is met by the last finish of its own bucket or the first of the next,
    so two equi-joins replace the interval join, without a row pair being formed.
    """
    spans = finishes.groupBy(by, chunk_of("ts_us", within_us).alias("_b")).agg(
        F.min("ts_us").alias("_min"), F.max("ts_us").alias("_max")
    )
    own = spans.select(by, "_b", F.col("_max").alias("_own"))
    following = spans.select(by, (F.col("_b") - 1).alias("_b"), F.col("_min").alias("_following"))
    placed = claims.withColumn("_b", chunk_of("ts_us", within_us))
    matched = placed.join(own, [by, "_b"], "left").join(following, [by, "_b"], "left")
    met = (F.col("_own") >= F.col("ts_us")) | (F.col("_following") <= F.col("ts_us") + within_us)
    return matched.filter(~F.coalesce(met, F.lit(False))).select(*claims.columns)


def orphaned(claims: DataFrame, live_owners: DataFrame, now_us: Column, by: str, self_owner: int, ttl_us: int) -> DataFrame:
    """Claims that may be taken over: their owner is gone, or they are older than the limit;
    never one's own."""
    alive = live_owners.select(by).distinct().withColumn("_alive", F.lit(True))
    joined = claims.filter(F.col(by) != self_owner).join(alive, by, "left")
    old = (now_us - F.col("ts_us")) > ttl_us
    return joined.filter(F.col("_alive").isNull() | old).select(
        *claims.columns, F.when(F.col("_alive").isNull(), "owner_gone").otherwise("too_old").alias("why")
    )


# -- money ---------------------------------------------------------------------


def settled_cost(worst: Column, usage: Column, status: Column, state: Column) -> Column:
    """What an attempt costs: its usage, nothing for a rejected status, else its worst case."""
    return (
        F.when(state == "in_flight", F.lit(0.0))
        .when(state == "billed", usage)
        .when(status.isin(*UNBILLED_STATUSES), F.lit(0.0))
        .otherwise(worst)
    )


def cost_ledger(attempts: DataFrame, by: str = "run_id") -> DataFrame:
    """Money ledger per run. ``attempts``: (run_id, state, status, worst_micros, usage_micros),
    amounts in whole micro-dollars so that sums are exact in any order."""
    usage, worst = F.col("usage_micros"), F.col("worst_micros")
    unknown = (F.col("state") == "failed") & ~F.coalesce(F.col("status").isin(*UNBILLED_STATUSES), F.lit(False))
    spent = F.when(F.col("state") == "billed", usage).when(unknown, worst).otherwise(F.lit(0))
    return attempts.groupBy(by).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum(spent).alias("spent_micros"),
        F.coalesce(F.sum(F.when(unknown, worst)), F.lit(0)).alias("unknown_micros"),
        F.coalesce(F.sum(F.when(F.col("state") == "in_flight", worst)), F.lit(0)).alias("outstanding_micros"),
        F.count_if((F.col("state") == "billed") & (usage > worst)).alias("estimate_violations"),
        F.sum(worst).alias("plan_worst_micros"),
    )

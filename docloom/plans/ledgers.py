"""Requests and replies, batches and caps, attempts and money."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import costs
from docloom.functions.text import truncate_marked
from docloom.operators import ledger, sets
from docloom.plans import fixtures
from docloom.plans.registry import query, table

# -- replies: expected ids in batches of eight, received ones partly wrong ---------------

_REPLIES = """
WITH requests AS (SELECT item_id // 8 AS batch_id, item_id AS id FROM benchmark),
replies AS (SELECT item_id // 8 AS batch_id, item_id AS id, item_id % 39 <> 13 AS ok FROM benchmark WHERE item_id % 32 <> 5
  UNION ALL SELECT item_id // 8, item_id + 100000, true FROM benchmark WHERE item_id % 48 = 11
  UNION ALL SELECT item_id // 8, item_id, true FROM benchmark WHERE item_id % 40 = 17),
got AS (SELECT batch_id, id, count(*) AS n, bool_and(ok) AS ok FROM replies GROUP BY ALL),
joined AS (SELECT batch_id, id, r.id IS NOT NULL AS sent, g.n, g.ok FROM requests r FULL JOIN got g USING (batch_id, id))"""


def _requests_replies(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    number = F.col("item_id")
    batch = F.floor(number / 8).alias("batch_id")
    requests = items.select(batch, number.alias("id"))
    replies = (
        items.filter(number % 32 != 5).select(batch, number.alias("id"), (number % 39 != 13).alias("ok"))
        .unionByName(items.filter(number % 48 == 11).select(batch, (number + 100_000).alias("id"), F.lit(True).alias("ok")))
        .unionByName(items.filter(number % 40 == 17).select(batch, number.alias("id"), F.lit(True).alias("ok")))
    )
    return requests, replies


@query("b11_valid_replies", _REPLIES + """
, per AS (SELECT batch_id, count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (NOT sent) AS n_unknown,
  count(*) FILTER (sent AND n > 1) AS n_duplicate, count(*) FILTER (n IS NOT NULL AND NOT ok) AS n_bad_fields FROM joined GROUP BY batch_id)
SELECT *, n_missing + n_unknown + n_duplicate + n_bad_fields = 0 AS valid FROM per""")
def valid_replies(spark, sf_dir):
    return ledger.reply_check(*_requests_replies(spark, sf_dir))


@query("c9_diagnose_reply", _REPLIES + """
SELECT batch_id, id, CASE WHEN n IS NULL THEN 'missing' WHEN NOT sent THEN 'unknown' ELSE 'duplicate' END AS problem
FROM joined WHERE n IS NULL OR NOT sent OR n > 1""")
def diagnose_reply(spark, sf_dir):
    return ledger.diagnose_reply(*_requests_replies(spark, sf_dir))


@query("g6_shared_keys", _REPLIES + " SELECT batch_id, id FROM requests INTERSECT SELECT batch_id, id FROM replies")
def shared_keys(spark, sf_dir):
    requests, replies = _requests_replies(spark, sf_dir)
    return sets.shared_keys(requests, replies.select("batch_id", "id"))


@query("c8_zip_reply", """
SELECT u.conv_id AS batch_id, u.turn AS id, u.text AS request, a.text AS reply FROM conversations u
JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def zip_reply(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    requests = turns.filter("role = 'user'").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("id"), F.col("text").alias("request"))
    replies = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("batch_id"), (F.col("turn") - 1).alias("id"), F.col("text").alias("reply")
    )
    return ledger.zip_reply(requests, replies)


@query("b12_retryable", """
WITH f AS (SELECT event_id, [200, 400, 404, 408, 409, 429, 500, 529][1 + event_id % 8] AS status,
  ['connect', 'pool', 'timeout', 'dropped', 'status', 'other'][1 + event_id % 6] AS outcome, event_id % 9 = 0 AS told_not_to FROM events)
SELECT event_id, (status IN (408, 409, 429) OR status >= 500) AND NOT told_not_to AS status_retryable,
       CASE outcome WHEN 'status' THEN status IN (408, 409, 429) OR status >= 500 WHEN 'other' THEN false ELSE true END AS retryable,
       outcome IN ('timeout', 'dropped', 'other') AS possibly_billed
FROM f""")
def retryable(spark, sf_dir):
    number = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 400, 404, 408, 409, 429, 500, 529)]), (number % 8 + 1).cast("int"))
    outcome = F.element_at(
        F.array(*[F.lit(o) for o in ("connect", "pool", "timeout", "dropped", "status", "other")]), (number % 6 + 1).cast("int")
    )
    told = F.when(number % 9 == 0, "false")
    return table(spark, sf_dir, "events").select(
        "event_id", costs.is_retryable(status, told).alias("status_retryable"), ledger.failure_class(outcome, status).alias("c")
    ).select("event_id", "status_retryable", "c.retryable", "c.possibly_billed")


# -- batches and caps: documents without a label are pending -----------------------------

_SENT = """CASE WHEN length(text) > 9160 THEN substr(text, 1, 9160) || ' [... ' || format('{:,}', length(text) - 9160) || ' more characters truncated]' ELSE text END"""
_BATCHES = f"""
WITH numbered AS (SELECT doc_id, {_SENT} AS sent, row_number() OVER (ORDER BY doc_id) - 1 AS i
                  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
batches AS (SELECT i // 40 AS batch_id, count(*) AS entries, CAST(sum(strlen(sent)) AS BIGINT) AS bytes FROM numbered GROUP BY 1)"""


def _batched(spark, sf_dir):
    pending = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return ledger.number_batches(pending.select("doc_id", "text"), "doc_id")


@query("d9_batch_payload_sizes", _BATCHES + " SELECT * FROM batches")
def batch_payload_sizes(spark, sf_dir):
    return ledger.batch_payload_sizes(_batched(spark, sf_dir), truncate_marked(F.col("text")))


@query("h5_1_build_payload", _BATCHES + """
SELECT i // 40 AS batch_id, CAST(to_json(struct_pack(items := list(struct_pack(id := 'e' || i % 40, text := sent) ORDER BY i))) AS VARCHAR) AS payload
FROM numbered GROUP BY 1""")
def build_payload(spark, sf_dir):
    return ledger.build_payloads(_batched(spark, sf_dir), truncate_marked(F.col("text")))


@query("d10_plan_caps", _BATCHES + """
, s AS (SELECT count(*) AS batches, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(bytes + 5095) AS BIGINT) AS total, max(bytes + 5095) AS top FROM batches),
c AS (SELECT batches, entries, 2 * batches + 4 AS max_requests, (least(32, batches) + 3) * 7168 + 128 * entries AS max_output,
        total + (2 * batches + 4 - batches) * top AS max_input FROM s)
SELECT *, round((max_input * 2.0::DOUBLE + max_output * 10.0::DOUBLE) / 1e6::DOUBLE, 6) AS worst_usd,
       (max_input * 2.0::DOUBLE + max_output * 10.0::DOUBLE) / 1e6::DOUBLE > 6.0 AS refused FROM c""")
def plan_caps(spark, sf_dir):
    sizes = ledger.batch_payload_sizes(_batched(spark, sf_dir), truncate_marked(F.col("text")))
    return ledger.plan_caps(sizes).withColumn("worst_usd", F.round("worst_usd", 6))


# -- attempts ----------------------------------------------------------------------------


@query("d11_ledger_usage", "WITH " + fixtures.ATTEMPTS + """
, u AS (SELECT run_id, count(*) AS requests,
  CAST(coalesce(sum(input_tokens) FILTER (state = 'billed'), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens) FILTER (state = 'billed'), 0) AS BIGINT) AS output_tokens,
  count(*) FILTER (state = 'cut_off') AS cut_off_requests,
  CAST(coalesce(sum(input_bound) FILTER (state = 'cut_off'), 0) AS BIGINT) AS cut_off_input,
  CAST(coalesce(sum(max_tokens) FILTER (state = 'cut_off'), 0) AS BIGINT) AS cut_off_output,
  count(*) FILTER (state = 'in_flight') AS in_flight_requests,
  CAST(coalesce(sum(input_bound) FILTER (state = 'in_flight'), 0) AS BIGINT) AS reserved_input,
  CAST(coalesce(sum(max_tokens) FILTER (state = 'in_flight'), 0) AS BIGINT) AS reserved_output FROM attempts GROUP BY run_id)
SELECT *, round(((input_tokens + cut_off_input + reserved_input) * 2.0::DOUBLE + (output_tokens + cut_off_output + reserved_output) * 10.0::DOUBLE) / 1e6::DOUBLE, 6) AS cost_usd FROM u""")
def ledger_usage(spark, sf_dir):
    return ledger.ledger_usage(fixtures.attempts(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


FIRST_FAILURE = "WITH " + fixtures.ATTEMPTS + """
SELECT run_id, arg_min(reason, ts_us) FILTER (reason IS NOT NULL) AS stop_reason, min(ts_us) FILTER (reason IS NOT NULL) AS stopped_at
FROM attempts GROUP BY run_id"""


@query("d24_first_failure", FIRST_FAILURE)
def first_failure(spark, sf_dir):
    return ledger.first_failure(fixtures.attempts(spark, sf_dir), order="ts_us")


_MONEY = "WITH " + fixtures.ATTEMPTS + """
, m AS (SELECT run_id, serial, ts_us, input_bound * 2 + max_tokens * 10 AS worst, input_tokens * 2 + output_tokens * 10 AS usage,
  [400, 429, 500, 529, 503][1 + serial % 5] AS status, CASE state WHEN 'billed' THEN 'billed' WHEN 'in_flight' THEN 'in_flight' ELSE 'failed' END AS state FROM attempts)"""


def _money(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in (400, 429, 500, 529, 503)]), (F.col("serial") % 5 + 1).cast("int"))
    return fixtures.attempts(spark, sf_dir).select(
        "run_id", "serial", "ts_us",
        (F.col("input_bound") * 2 + F.col("max_tokens") * 10).alias("worst_micros"),
        (F.col("input_tokens") * 2 + F.col("output_tokens") * 10).alias("usage_micros"),
        status.alias("status"),
        F.when(F.col("state").isin("billed", "in_flight"), F.col("state")).otherwise("failed").alias("state"),
    )


@query("d26_cost_ledger", _MONEY + """
, s AS (SELECT *, state = 'failed' AND status NOT IN (400, 401, 403, 404, 413, 429) AS unknown FROM m)
SELECT run_id, count(*) AS attempts,
  CAST(sum(CASE WHEN state = 'billed' THEN usage WHEN unknown THEN worst ELSE 0 END) AS BIGINT) AS spent_micros,
  CAST(coalesce(sum(worst) FILTER (unknown), 0) AS BIGINT) AS unknown_micros,
  CAST(coalesce(sum(worst) FILTER (state = 'in_flight'), 0) AS BIGINT) AS outstanding_micros,
  count(*) FILTER (state = 'billed' AND usage > worst) AS estimate_violations, CAST(sum(worst) AS BIGINT) AS plan_worst_micros
FROM s GROUP BY run_id""")
def cost_ledger(spark, sf_dir):
    return ledger.cost_ledger(_money(spark, sf_dir))


@query("d26_cost_admission", _MONEY + """
, r AS (SELECT *, row_number() OVER w - 1 AS before, sum(worst) OVER w AS through FROM m WINDOW w AS (PARTITION BY run_id ORDER BY serial)),
f AS (SELECT *, CASE WHEN before >= 60 THEN 'max_requests' WHEN through > 1500000 THEN 'max_output' END AS why FROM r),
g AS (SELECT *, min(serial) FILTER (why IS NOT NULL) OVER (PARTITION BY run_id) AS first FROM f)
SELECT run_id, serial, worst AS worst_micros, CASE WHEN serial = first THEN why WHEN serial > first THEN 'stopped' END AS refusal FROM g""")
def cost_admission(spark, sf_dir):
    """Reservations in micro-dollars against a money cap of 1.50 and 60 attempts."""
    log = _money(spark, sf_dir).select(
        "run_id", "serial", "ts_us", F.col("worst_micros").alias("out_delta"), F.lit(0).cast("bigint").alias("in_delta"), F.lit(True).alias("is_attempt")
    )
    decided = ledger.admit_under_caps(log, 60, 1_500_000, 1, float(10 * 365 * 86400))
    return decided.select("run_id", "serial", F.col("out_delta").alias("worst_micros"), "refusal")


@query("e6_requests_in_flight", "WITH " + fixtures.ATTEMPTS + """
, d AS (SELECT run_id, at_us, sum(d) AS d FROM (SELECT run_id, ts_us AS at_us, 1 AS d FROM attempts
        UNION ALL SELECT run_id, ts_us + CAST(floor(value) AS BIGINT) * 60000000, -1 FROM attempts) GROUP BY ALL),
r AS (SELECT run_id, at_us, CAST(sum(d) OVER (PARTITION BY run_id ORDER BY at_us) AS BIGINT) AS in_flight FROM d)
SELECT run_id, at_us, in_flight FROM r""")
def requests_in_flight(spark, sf_dir):
    return ledger.requests_in_flight(_intervals(spark, sf_dir))


def _intervals(spark, sf_dir):
    """Open for as many minutes as the event's value says."""
    return fixtures.attempts(spark, sf_dir).select(
        "run_id", F.col("ts_us").alias("start_us"), (F.col("ts_us") + F.floor("value") * 60_000_000).alias("end_us")
    )


@query("e6_peak_in_flight", "WITH " + fixtures.ATTEMPTS + """
, d AS (SELECT run_id, at_us, sum(d) AS d FROM (SELECT run_id, ts_us AS at_us, 1 AS d FROM attempts
        UNION ALL SELECT run_id, ts_us + CAST(floor(value) AS BIGINT) * 60000000, -1 FROM attempts) GROUP BY ALL)
SELECT run_id, max(n) AS peak FROM (SELECT run_id, CAST(sum(d) OVER (PARTITION BY run_id ORDER BY at_us) AS BIGINT) AS n FROM d) GROUP BY run_id""")
def peak_in_flight(spark, sf_dir):
    return ledger.peak_in_flight(_intervals(spark, sf_dir))


CAPS = {"max_requests": 50, "max_output": 200_000, "max_input": 260_000, "time_limit_s": 20 * 86400.0}
ADMITTED = "WITH " + fixtures.ATTEMPTS + """
, r AS (SELECT *, row_number() OVER w - 1 AS before, sum(max_tokens) OVER w AS out_through, sum(input_bound) OVER w AS in_through,
          min(ts_us) OVER (PARTITION BY run_id) AS start_us FROM attempts WINDOW w AS (PARTITION BY run_id ORDER BY serial)),
f AS (SELECT *, CASE WHEN ts_us >= start_us + 20 * 86400000000 THEN 'time_limit' WHEN before >= 50 THEN 'max_requests'
                     WHEN out_through > 200000 THEN 'max_output' WHEN in_through > 260000 THEN 'max_input' END AS why FROM r),
g AS (SELECT *, min(serial) FILTER (why IS NOT NULL) OVER (PARTITION BY run_id) AS first FROM f)
SELECT run_id, serial, CASE WHEN serial = first THEN why WHEN serial > first THEN 'stopped' END AS refusal, serial < coalesce(first, serial + 1) AS admitted FROM g"""


def attempt_log(attempts):
    return attempts.select(
        "run_id", "serial", "ts_us", F.col("max_tokens").alias("out_delta"), F.col("input_bound").alias("in_delta"), F.lit(True).alias("is_attempt")
    )


@query("e7_admit_under_caps", ADMITTED)
def admit_under_caps(spark, sf_dir):
    decided = ledger.admit_under_caps(attempt_log(fixtures.attempts(spark, sf_dir)), **CAPS)
    return decided.select("run_id", "serial", "refusal", "admitted")


@query("e7_admit_with_settlements", "WITH " + fixtures.ATTEMPTS + """
, log AS (SELECT run_id, serial * 2 AS serial, ts_us, max_tokens AS d, true AS is_attempt FROM attempts
  UNION ALL SELECT run_id, serial * 2 + 1, ts_us, output_tokens - max_tokens, false FROM attempts WHERE state = 'billed'),
r AS (SELECT *, coalesce(sum(CAST(is_attempt AS INTEGER)) OVER w, 0) AS before, coalesce(sum(d) OVER w, 0) AS committed FROM log
      WINDOW w AS (PARTITION BY run_id ORDER BY serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN is_attempt AND before >= 50 THEN 'max_requests' WHEN is_attempt AND committed + d > 90000 THEN 'max_output' END AS why FROM r),
g AS (SELECT *, min(serial) FILTER (why IS NOT NULL) OVER (PARTITION BY run_id) AS first FROM f)
SELECT run_id, serial, CASE WHEN serial = first THEN why WHEN serial > first THEN 'stopped' END AS refusal FROM g WHERE is_attempt""")
def admit_with_settlements(spark, sf_dir):
    """Billed attempts settle what they reported, less or more than reserved, before the next attempt."""
    rows = fixtures.attempts(spark, sf_dir)
    zero = F.lit(0).cast("bigint").alias("in_delta")
    asked = rows.select("run_id", (F.col("serial") * 2).alias("serial"), "ts_us", F.col("max_tokens").alias("out_delta"), zero, F.lit(True).alias("is_attempt"))
    back = F.col("output_tokens") - F.col("max_tokens")
    settled = rows.filter("state = 'billed'").select(
        "run_id", (F.col("serial") * 2 + 1).alias("serial"), "ts_us", back.alias("out_delta"), zero, F.lit(False).alias("is_attempt")
    )
    decided = ledger.admit_under_caps(asked.unionByName(settled), 50, 90_000, 1, float(10 * 365 * 86400))
    return decided.filter("is_attempt").select("run_id", "serial", "refusal")


@query("e8_over_reservation", "WITH " + fixtures.ATTEMPTS + """
, o AS (SELECT run_id, serial, state = 'billed' AND (input_tokens > input_bound OR output_tokens > max_tokens) AS over FROM attempts)
SELECT run_id, serial, over FROM (SELECT *, bool_or(over) OVER (PARTITION BY run_id ORDER BY serial) AS since FROM o) WHERE since""")
def over_reservation(spark, sf_dir):
    return ledger.over_reservation(fixtures.attempts(spark, sf_dir)).select("run_id", "serial", "over")


@query("e9_attempt_numbers", """
SELECT user_id, event_type, event_id, row_number() OVER w AS attempt,
       CASE WHEN row_number() OVER w < 3 THEN least(2.0::DOUBLE * pow(2.0::DOUBLE, row_number() OVER w - 1), 30.0::DOUBLE) END AS wait_s
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def attempt_numbers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    numbered = ledger.attempt_numbers(events, ["user_id", "event_type"], "event_id")
    wait = costs.retry_delay(F.lit(None).cast("double"), F.col("attempt"))
    return numbered.withColumn("wait_s", F.when(F.col("attempt") < costs.MAX_ATTEMPTS, wait))


# -- claims ------------------------------------------------------------------------------

HOUR_US = 3_600_000_000


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    )


@query("b13_orphaned", """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS ts_us, (SELECT max(epoch_us(ts)) FROM events) AS now FROM events),
live AS (SELECT DISTINCT user_id FROM e WHERE now - ts_us <= 36000000000)
SELECT user_id, event_id, ts_us, CASE WHEN user_id NOT IN (SELECT user_id FROM live) THEN 'owner_gone' ELSE 'too_old' END AS why
FROM e WHERE event_type = 'view' AND user_id <> 7 AND (user_id NOT IN (SELECT user_id FROM live) OR now - ts_us > 3600000000)""")
def orphaned(spark, sf_dir):
    """Owners count as alive when they were active in the last ten hours."""
    timed = _timed(spark, sf_dir)
    now = timed.agg(F.max("ts_us")).scalar()
    live = timed.filter(now - F.col("ts_us") <= 10 * HOUR_US).select("user_id")
    claims = timed.filter("event_type = 'view'")
    taken = ledger.orphaned(claims, live, now, "user_id", 7, HOUR_US)
    return taken.select("user_id", "event_id", "ts_us", "why")


UNFINISHED = """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS ts_us, (SELECT max(epoch_us(ts)) FROM events) AS now FROM events)
SELECT user_id, event_id, ts_us FROM e c WHERE event_type = 'view' AND ts_us + 86400000000 < now AND NOT EXISTS (
  SELECT 1 FROM e f WHERE f.event_type = 'purchase' AND f.user_id = c.user_id AND f.ts_us >= c.ts_us AND f.ts_us <= c.ts_us + 86400000000)"""


@query("b13_unfinished_claims", UNFINISHED)
def unfinished_claims(spark, sf_dir):
    timed = _timed(spark, sf_dir)
    now = timed.agg(F.max("ts_us")).scalar()
    due = timed.filter("event_type = 'view'").filter(F.col("ts_us") + 24 * HOUR_US < now)
    finishes = timed.filter("event_type = 'purchase'")
    return ledger.unfinished_claims(due, finishes, "user_id", 24 * HOUR_US).select("user_id", "event_id", "ts_us")

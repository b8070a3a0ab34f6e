"""Caps, admission and claims against step-by-step computation."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import ledger


@pytest.mark.parametrize(
    ("entries", "sizes", "expected"),
    [
        (28, [4649], (6, 32_256, 58_464, 0.44)),
        (995, [14_760] + [(201_349 - 14_760) // 24] * 23 + [(201_349 - 14_760) - 23 * ((201_349 - 14_760) // 24)], (54, 328_064, 904_519, 5.09)),
    ],
)
def test_plan_caps(spark, entries, sizes, expected):
    per = [entries // len(sizes)] * (len(sizes) - 1)
    rows = list(zip([*per, entries - sum(per)], sizes))
    row = ledger.plan_caps(spark.createDataFrame(rows, "entries bigint, bytes bigint")).first()
    assert (row.max_requests, row.max_output, row.max_input) == expected[:3]
    assert row.worst_usd == pytest.approx(expected[3], abs=0.006) and not row.refused


def simulate(log, caps):
    """One run, attempt by attempt."""
    start = min(r[2] for r in log)
    requests = out = into = 0
    stopped, decided = False, {}
    for _, serial, ts, d_out, d_in, attempt in sorted(log, key=lambda r: r[1]):
        why = None
        if attempt:
            if stopped:
                why = "stopped"
            elif ts >= start + caps["time_limit_s"] * 1e6:
                why = "time_limit"
            elif requests >= caps["max_requests"]:
                why = "max_requests"
            elif out + d_out > caps["max_output"]:
                why = "max_output"
            elif into + d_in > caps["max_input"]:
                why = "max_input"
            decided[serial] = why
            stopped = stopped or why is not None
        if not stopped:
            requests, out, into = requests + bool(attempt), out + d_out, into + d_in
    return decided


def random_log(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        run = 0 if i % 3 == 0 else rng.randrange(1, 12)
        attempt = rng.random() < 0.7
        d = rng.randrange(1, 60)
        rows.append((run, i, i * 1_000_000, d if attempt else -rng.randrange(0, 25), d if attempt else 0, attempt))
    return rows


CAPS = {"max_requests": 40, "max_output": 700, "max_input": 1500, "time_limit_s": 450.0}
LOG = "run_id bigint, serial bigint, ts_us bigint, out_delta bigint, in_delta bigint, is_attempt boolean"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission(spark, seed):
    log = random_log(seed)
    found = ledger.admit_under_caps(spark.createDataFrame(log, LOG), **CAPS).filter("is_attempt").collect()
    expected = {}
    for run in {r[0] for r in log}:
        expected.update(simulate([r for r in log if r[0] == run], CAPS))
    assert {r.serial: r.refusal for r in found} == expected
    assert {r.refusal for r in found} >= {None, "stopped"}


def test_in_flight(spark):
    rows = [(1, 0, 10), (1, 5, 10), (1, 10, 20), (2, 3, 4)]
    peaks = ledger.peak_in_flight(spark.createDataFrame(rows, "run_id bigint, start_us bigint, end_us bigint")).collect()
    assert {r.run_id: r.peak for r in peaks} == {1: 2, 2: 1}


@pytest.mark.parametrize("within", [1, 7, 50])
def test_unfinished_claims(spark, within):
    rng = random.Random(within)
    claims = [(0 if i % 3 == 0 else rng.randrange(1, 6), i, rng.randrange(0, 400)) for i in range(150)]
    finishes = [(rng.randrange(0, 6), rng.randrange(0, 400)) for _ in range(60)]
    left = ledger.unfinished_claims(
        spark.createDataFrame(claims, "owner bigint, id bigint, ts_us bigint"), spark.createDataFrame(finishes, "owner bigint, ts_us bigint"), "owner", within
    )
    expected = {c[1] for c in claims if not any(f[0] == c[0] and c[2] <= f[1] <= c[2] + within for f in finishes)}
    assert {r.id for r in left.collect()} == expected


def test_replies(spark):
    requests = spark.createDataFrame([(b, i) for b in range(4) for i in range(3)], "batch_id int, id int")
    good = [(b, i, True) for b in range(4) for i in range(3)]
    replies = [r for r in good if r[:2] != (1, 2)] + [(2, 9, True), (3, 0, True)]
    valid = {r.batch_id: r.valid for r in ledger.reply_check(requests, spark.createDataFrame(replies, "batch_id int, id int, ok boolean")).collect()}
    assert valid == {0: True, 1: False, 2: False, 3: False}
    wrong = ledger.diagnose_reply(requests, spark.createDataFrame(replies, "batch_id int, id int, ok boolean")).collect()
    assert {(r.batch_id, r.id, r.problem) for r in wrong} == {(1, 2, "missing"), (2, 9, "unknown"), (3, 0, "duplicate")}


def test_batches_keep_their_size(spark):
    rows = spark.range(0, 2050, 2).select(F.col("id").alias("ord"))
    sizes = ledger.number_batches(rows, "ord").groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in sizes] == [40] * 25 + [25]

"""Order-dependent building blocks against plain computation, with one group holding a third."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ordered


@pytest.fixture(autouse=True, params=[0, 50, 1 << 17], ids=["all large", "hot one large", "none large"])
def sizes(request, monkeypatch):
    """Small bounds, so that few rows pass every level."""
    monkeypatch.setattr(ordered, "GROUP_ROWS", request.param)
    monkeypatch.setattr(ordered, "WIDTH", 5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    keys = rng.sample(range(-300, 3000), 900)
    return [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", k, rng.randrange(-5, 20), rng.choice([None, 1.5, 2.25, 7.0, rng.random() * 100]))
            for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "grp string, ord bigint, amount bigint, v double").repartition(5)


def grouped(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize(("width", "inclusive"), [(1, True), (7, False), (64, True)])
def test_running_totals(table, rows, width, inclusive):
    found = ordered.running_totals(table, ["grp"], "ord", {"total": F.col("amount")}, width, inclusive)
    expected = set()
    for group, members in grouped(rows).items():
        total = 0
        for _, order, amount, _ in members:
            expected.add((group, order, total + amount if inclusive else total))
            total += amount
    assert {(r.grp, r.ord, r.total) for r in found.collect()} == expected


def test_ordinals_overall_and_by_group(table, rows):
    overall = ordered.with_ordinal(table, [], "ord", width=16).collect()
    assert [r.ord for r in sorted(overall, key=lambda r: r.seq)] == sorted(r[1] for r in rows)
    for group, members in grouped(rows).items():
        places = {r.ord: r.seq for r in ordered.with_ordinal(table, ["grp"], "ord", width=16).filter(F.col("grp") == group).collect()}
        assert places == {m[1]: i + 1 for i, m in enumerate(members)}
        break


def test_neighbours(table, rows):
    found = {(r.grp, r.ord): (r.b, r.a) for r in ordered.neighbour_values(table, ["grp"], "ord", "ord", "b", "a", width=5).collect()}
    for group, members in grouped(rows).items():
        orders = [None, *[m[1] for m in members], None]
        for i, order in enumerate(orders[1:-1], 1):
            assert found[(group, order)] == (orders[i - 1], orders[i + 1])


def test_sorted_ordinal(table, rows):
    placed = ordered.sorted_ordinal(table, [F.col("grp"), F.col("ord")]).collect()
    assert [(r.grp, r.ord) for r in sorted(placed, key=lambda r: r.seq)] == sorted((r[0], r[1]) for r in rows)
    assert sorted(r.seq for r in placed) == list(range(1, len(rows) + 1))


def test_top_k(table, rows):
    found = ordered.top_k(table, ["grp"], [F.col("ord")], 2).collect()
    expected = {(g, m[1], i + 1) for g, members in grouped(rows).items() for i, m in enumerate(members[:2])}
    assert {(r.grp, r.ord, r.seq) for r in found} == expected


@pytest.mark.parametrize("slices", [2, 7, 128])
def test_quantiles_with_any_slices(table, rows, slices):
    probs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    found = {r.grp: r for r in ordered.quantiles(table, ["grp"], F.col("v"), probs, slices=slices).collect()}
    for group, members in grouped(rows).items():
        values = [m[3] for m in members if m[3] is not None]
        if not values:
            assert group not in found
            continue
        assert found[group].n == len(values)
        for name, p in probs.items():
            assert found[group][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


@pytest.mark.parametrize("slices", [2, 128])
def test_quantiles_weighted_and_nan(spark, slices):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (float("nan"), 9), (None, 9), (9.0, 96)], "v double, w bigint")
    row = ordered.quantiles(df, [], F.col("v"), {"q": 0.03, "m": 0.5}, weight=F.col("w"), slices=slices).first()
    values = [1.0] * 3 + [5.0] + [9.0] * 96
    assert row.n == 100 and row.q == pytest.approx(np.quantile(values, 0.03)) and row.m == 9.0


@pytest.mark.parametrize("slices", [2, 128])
def test_null_group_keys_are_a_group(spark, slices):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "grp string, ord bigint")
    placed = ordered.with_ordinal(df, ["grp"], "ord", width=1).collect()
    assert {(r.grp, r.ord, r.seq) for r in placed} == {(None, 1, 1), ("a", 2, 1), (None, 3, 2)}
    beside = ordered.neighbour_values(df, ["grp"], "ord", "ord", "b", "a", width=1).collect()
    assert {(r.grp, r.ord, r.b, r.a) for r in beside} == {(None, 1, None, 3), ("a", 2, None, None), (None, 3, 1, None)}
    middle = ordered.quantiles(df, ["grp"], F.col("ord"), {"q": 0.5}, slices=slices).collect()
    assert {(r.grp, r.n, r.q) for r in middle} == {(None, 2, 2.0), ("a", 1, 2.0)}


def test_large_order_keys_keep_all_digits(spark):
    base = 1_001_000_000_000_000_000
    df = spark.range(300).select((F.col("id") + base).alias("ord"))
    placed = ordered.with_ordinal(df, [], "ord", width=7).collect()
    assert {r.ord - base + 1 == r.seq for r in placed} == {True}


def test_unknown_versions_are_named(spark):
    from docloom.operators import changelog

    rows = spark.range(1, 5).selectExpr("named_struct('major', 1, 'minor', cast(id as int) * 2, 'patch', 0) AS version")
    ranged, swapped = changelog.checked_range(rows, "1.8.0", "1.2.0")
    assert (ranged.count(), swapped) == (3, True)
    assert changelog.checked_range(rows, "1.2.0", "1.4.0")[1] is False
    with pytest.raises(ValueError, match=r"1\.5\.0; nearest below: 1\.4\.0, nearest above: 1\.6\.0"):
        changelog.checked_range(rows, "1.5.0", "1.8.0")
    with pytest.raises(ValueError, match="nearest above: none"):
        changelog.checked_range(rows, "1.2.0", "2.0.0")


def test_neighbours_over_sparse_ranges(spark):
    from docloom.operators import changelog

    known = [3, 1 << 20, (1 << 40) + 7, (1 << 50) + 1, (1 << 50) + 2]
    probes = [-(1 << 45), 3, 4, 1 << 19, 1 << 33, (1 << 40) + 7, 1 << 45, (1 << 50) + 1, 1 << 55]
    found = changelog.nearest_known(
        spark.createDataFrame([(k,) for k in probes], "vnum long"), spark.createDataFrame([(k,) for k in known], "vnum long")
    )
    expected = {p: (max((k for k in known if k < p), default=None), min((k for k in known if k > p), default=None)) for p in probes}
    assert {r.vnum: (r.nearest_lower, r.nearest_higher) for r in found.collect()} == expected


def test_dense_intervals_stay_within_the_width(spark):
    from docloom.operators import ledger

    spans = spark.range(500).selectExpr("id % 2 AS run_id", "1000 + id AS start_us", "1000 + id + 1 + id % 7 AS end_us")
    found = {(r.run_id, r.at_us): r.in_flight for r in ledger.requests_in_flight(spans, width=16).collect()}
    rows = [(i % 2, 1000 + i, 1001 + i + i % 7) for i in range(500)]
    assert found and all(n == sum(r == run and a <= at < b for r, a, b in rows) for (run, at), n in found.items())


def test_quantiles_have_the_same_bits_with_any_slices(table):
    def bits(slices):
        found = ordered.quantiles(table, ["grp"], F.col("v"), {"a": 0.013, "b": 0.5, "c": 0.977}, slices=slices).collect()
        return {r.grp: (r.n, r.a, r.b, r.c) for r in found}

    assert bits(2) == bits(9) == bits(128)


def test_rows_with_texts_take_small_windows(spark):
    """No task's window holds all texts of a large table: batches are numbered in chunks."""
    from docloom.operators import ledger

    n = 3 * ordered.TEXT_WIDTH
    rows = spark.range(n).selectExpr("id * 7 AS ord", "CAST(id AS STRING) AS text")
    parts = ordered._marked(rows, [], "ord", ordered.TEXT_WIDTH)
    held = parts.groupBy(ordered._GROUP, ordered._CHUNK).count().agg(F.max("count")).first()[0]
    assert held <= ordered.TEXT_WIDTH
    found = ledger.number_batches(rows, "ord")
    assert "_t__seq" in found._jdf.queryExecution().analyzed().toString()
    assert found.where("batch_id <> (ord div 7) div 40 OR place <> (ord div 7) % 40").isEmpty() and found.count() == n


def test_a_large_group_is_spread_over_tasks(spark):
    """Rows of one group go to tasks by chunk: no shuffle by the group alone comes before the window."""
    n = 16 * ordered.TEXT_WIDTH
    rows = spark.range(0, n, 1, 4).selectExpr("'one' AS grp", "id AS ord", "repeat('x', 20) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordered.with_ordinal(rows, ["grp"], "ord", width=ordered.TEXT_WIDTH)
        held = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.bool_and(F.col("seq") == F.col("ord") + 1).alias("ok")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in held) == n and all(r.ok for r in held)
    if ordered.GROUP_ROWS <= n:
        assert max(r.n for r in held) < n

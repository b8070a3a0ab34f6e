"""Order-dependent building blocks that never put one large group into one task.

A group may hold a third of the table, so ``Window.partitionBy(group)`` is only used on groups
of at most ``GROUP_ROWS`` rows (counted, not assumed; ``2 * width`` if that is less). Larger groups are cut into chunks by a
unique whole-number order key: one chunk holds at most ``width`` rows of a group. A window runs
inside each chunk, and per-chunk totals supply what all earlier chunks contribute. The totals
are combined in further levels of the same kind, each bounded by ``WIDTH``, so that sparse
order keys do not gather them either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.session import cut

WIDTH = 1 << 16
# For rows that carry whole texts: a task's window then holds some megabytes.
TEXT_WIDTH = 1 << 12
# Levels above the chunks: 16 bits of a 64-bit order key each.
LEVELS = 2
# Rows of one group that one task may hold.
GROUP_ROWS = 1 << 17
# Slices of a group's values, of which a quantile sorts only those that hold a wanted rank.
SLICES = 128
_CHUNK = "_chunk"
_GROUP = "_group"


def group_key(by: Sequence[str]) -> Column:
    """The group columns as one struct, which is never null and compares null fields as equal,
    so joins on it lose no group. Without columns all rows are one group."""
    return F.struct(*by) if by else F.lit(0)


def chunk_of(order: str, width: int) -> Column:
    """Number of the chunk an order key falls into (whole-number division keeps all digits)."""
    return F.expr(f"`{order}` div {width}")


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group results: null group keys match, and no keys means a one-row right side."""
    if not keys:
        return left.select("*", *[right.select(name).scalar().alias(name) for name in right.columns])
    rest = [name for name in right.columns if name not in keys]
    keyed = right.select(group_key(keys).alias(_GROUP), *rest)
    return left.withColumn(_GROUP, group_key(keys)).join(keyed, _GROUP, how).drop(_GROUP)


def _marked(df: DataFrame, by: Sequence[str], order: str, width: int, *more: Column) -> DataFrame:
    """Rows with their group and, in large groups only, their chunk (null elsewhere)."""
    grouped = df.select("*", group_key(by).alias(_GROUP), *more)
    most = min(GROUP_ROWS, 2 * width)
    if not by:
        large = grouped.agg(F.count(F.lit(1))).scalar() > most
        return grouped.withColumn("_large", large).withColumn(_CHUNK, F.when(F.col("_large"), chunk_of(order, width)))
    sizes = grouped.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    # At most one group per ``most`` rows of the table. They are sent to the rows: a shuffle by group would also
    # serve the window over chunks, and bring a whole group to one task.
    large = F.broadcast(sizes.select(_GROUP, F.lit(True).alias("_large")))
    return grouped.join(large, _GROUP, "left").withColumn(_CHUNK, F.when(F.col("_large"), chunk_of(order, width)))


def _before(totals: DataFrame, columns: dict[str, str], level: int) -> DataFrame:
    """Per chunk, the sum of ``columns`` over all earlier chunks of the same group."""
    below = [_GROUP] if level == 0 else [_GROUP, "_above"]
    frame = W.partitionBy(*below).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    placed = totals if level == 0 else totals.withColumn("_above", chunk_of(_CHUNK, WIDTH))
    within = placed.select(
        *below, _CHUNK, *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(out) for c, out in columns.items()]
    )
    if level == 0:
        return within
    sums = placed.groupBy(*below).agg(*[F.sum(c).alias(c) for c in columns]).withColumnRenamed("_above", _CHUNK)
    earlier = _before(sums, {c: f"{out}_above" for c, out in columns.items()}, level - 1)
    return within.join(earlier.withColumnRenamed(_CHUNK, "_above"), below).select(
        _GROUP, _CHUNK, *[(F.col(out) + F.col(f"{out}_above")).alias(out) for out in columns.values()]
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    totals: dict[str, Column],
    width: int = WIDTH,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums of ``totals`` in ``order`` within each group.

    ``order`` is a whole number, unique within the group. Null summands count as zero.
    """
    names, keys = list(totals), [_GROUP, _CHUNK]
    inputs = [F.coalesce(expr, F.lit(0)).alias(f"_in_{n}") for n, expr in totals.items()]
    parts = _marked(df, by, order, width, *inputs)
    sums = parts.filter("_large").groupBy(*keys).agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in names])
    earlier = _before(sums, {f"_t_{n}": f"_b_{n}" for n in names}, LEVELS)
    last = 0 if inclusive else -1
    frame = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, last)
    local = parts.select(
        *df.columns, *keys, *[F.coalesce(F.sum(f"_in_{n}").over(frame), F.lit(0)).alias(f"_l_{n}") for n in names]
    )
    # Rows of small groups have no chunk and meet nothing here.
    return local.join(earlier, keys, "left").select(
        *df.columns, *[(F.col(f"_l_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in names]
    )


def with_ordinal(df: DataFrame, by: Sequence[str], order: str, out: str = "seq", width: int = WIDTH) -> DataFrame:
    """Number the rows of each group from 1 by a unique whole-number ``order`` column."""
    return running_totals(df, by, order, {out: F.lit(1)}, width)


def _across(ends: DataFrame, level: int) -> DataFrame:
    """Per chunk, the last value of the chunk before it and the first of the one after it."""
    below = [_GROUP] if level == 0 else [_GROUP, "_above"]
    frame = W.partitionBy(*below).orderBy(_CHUNK)
    placed = ends if level == 0 else ends.withColumn("_above", chunk_of(_CHUNK, WIDTH))
    within = placed.select(
        *below, _CHUNK, F.lag("_last").over(frame).alias("_from_before"), F.lead("_first").over(frame).alias("_from_after")
    )
    if level == 0:
        return within
    outer = placed.groupBy(*below).agg(F.min_by("_first", _CHUNK).alias("_first"), F.max_by("_last", _CHUNK).alias("_last"))
    beyond = _across(outer.withColumnRenamed("_above", _CHUNK), level - 1).select(
        _GROUP, F.col(_CHUNK).alias("_above"), F.col("_from_before").alias("_b"), F.col("_from_after").alias("_a")
    )
    return within.join(beyond, below).select(
        _GROUP, _CHUNK, F.coalesce("_from_before", "_b").alias("_from_before"), F.coalesce("_from_after", "_a").alias("_from_after")
    )


def neighbour_values(
    df: DataFrame, by: Sequence[str], order: str, value: str, before: str, after: str, width: int = WIDTH
) -> DataFrame:
    """Previous and next ``value`` (never null) of each row by a unique whole-number ``order``."""
    keys = [_GROUP, _CHUNK]
    parts = _marked(df, by, order, width)
    frame = W.partitionBy(*keys).orderBy(order)
    ends = parts.filter("_large").groupBy(*keys).agg(
        F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last")
    )
    local = parts.withColumn("_lag", F.lag(value).over(frame)).withColumn("_lead", F.lead(value).over(frame))
    return local.join(_across(ends, LEVELS), keys, "left").select(
        *df.columns,
        F.coalesce("_lag", "_from_before").alias(before),
        F.coalesce("_lead", "_from_after").alias(after),
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "seq") -> DataFrame:
    """First ``k`` rows of each group. The rank filter becomes a per-task group limit before
    the shuffle, so at most ``k`` rows per group and task travel."""
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window).cast("bigint")).filter(F.col(out) <= k)


def sorted_ordinal(df: DataFrame, order: Sequence[Column], out: str = "seq") -> DataFrame:
    """Number all rows from 1 in a global sort order of any type.

    Range-partitioned sort, written with its partition numbers to the shared scratch folder;
    per-partition counts then give each partition its offset.
    """
    ranged = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    )
    # One row per partition; the first identifier of a partition is its smallest.
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    offsets = counts.select(
        "_pid",
        "_base",
        F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    return ranged.join(F.broadcast(offsets), "_pid").select(
        *df.columns, (F.col("_mid") - F.col("_base") + F.col("_off") + 1).alias(out)
    )


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column,
    probs: dict[str, float],
    weight: Column | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, plus ``n``. NaN and null values are left out.

    Equal values are counted first (map-side). A sketch of bounded size cuts every group's values
    into at most ``slices`` slices; slice totals say which few of them hold the wanted ranks, and
    only those are sorted: a task holds about 1/``slices`` of a group's distinct values. No job runs
    while the plan is built, and groups of all sizes take the same way.
    """
    rows = df.select(
        group_key(by).alias(_GROUP), value.cast("double").alias("_v"), (weight if weight is not None else F.lit(1)).alias("_w")
    )
    counts = rows.filter("_v IS NOT NULL AND NOT isnan(_v)").groupBy(_GROUP, "_v").agg(F.expr("sum(_w) AS _c"))
    cuts = ", ".join(f"{i / slices}D" for i in range(1, slices))
    shape = counts.groupBy(_GROUP).agg(
        F.expr("sum(_c) AS _n"), F.expr(f"percentile_approx(_v, array({cuts}), {16 * slices}) AS _cuts")
    )
    sliced = counts.join(shape, _GROUP).selectExpr("*", f"size(filter(_cuts, c -> c < _v)) AS {_CHUNK}")
    # The sketch is looked at once: from here on a slice is known by its bounds.
    weights = sliced.groupBy(_GROUP, _CHUNK).agg(
        F.expr("sum(_c) AS _t"), F.expr("max(_n) AS _n"), F.expr(f"max(get(_cuts, {_CHUNK} - 1)) AS _lo"), F.expr(f"max(get(_cuts, {_CHUNK})) AS _hi")
    )
    # At most ``slices`` rows per group.
    run = W.partitionBy(_GROUP).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    placed = weights.withColumn("_off", F.coalesce(F.sum("_t").over(run), F.lit(0)))
    rank = {name: f"({p}D * (_n - 1))" for name, p in probs.items()}
    ends = [f"{end}({r})" for r in rank.values() for end in ("floor", "ceil")]
    needed = placed.filter(" OR ".join(f"({e} >= _off AND {e} < _off + _t)" for e in ends))
    needed = needed.select(F.col(_GROUP).alias("_g"), _CHUNK, "_off", "_n", "_lo", "_hi")
    inside = W.partitionBy(_GROUP, _CHUNK).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    held = F.expr(f"{_GROUP} = _g AND (_lo IS NULL OR _v > _lo) AND (_hi IS NULL OR _v <= _hi)")
    ranked = counts.join(needed, held).withColumn("_cum", F.sum("_c").over(inside) + F.col("_off"))
    found = ranked.groupBy(_GROUP).agg(
        F.expr("max(_n) AS _n"),
        *[
            F.expr(f"min(CASE WHEN _cum > {end}({r}) THEN _v END) AS _{end}_{name}")
            for name, r in rank.items()
            for end in ("floor", "ceil")
        ],
    )
    return found.select(
        *[F.col(_GROUP)[name].alias(name) for name in by],
        F.col("_n").alias("n"),
        *[F.expr(f"_floor_{n} + (_ceil_{n} - _floor_{n}) * ({r} - floor({r}))").alias(n) for n, r in rank.items()],
    )

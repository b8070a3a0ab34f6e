"""Mixing sources to target weights by hash thresholds.

Sizes are summed per source and hash bucket. The bucket in which a source's budget runs out is the
only one looked at again, with the next hash bits, until it holds one hash value. A document is
taken if its hash lies below its source's threshold, so nothing is sorted, a larger budget always
takes a superset, and a rerun takes the same rows.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
``share`` of all sizes. A target stops at ``most`` times its source's size; the excess is dealt to
the others by weight until none is above. A source with target ``k`` sizes and a rest takes every
document ``k`` times, and those below the threshold once more.

Defined cases: a null text has size 0; a null source is a source; rows with equal ids share a hash
and are taken or left together; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import WORD, cut, hash60
from docloom.operators.ordered import sorted_ordinal

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
# Hash bits that each round of refinement looks at; a source has at most 2^BITS buckets a round.
BITS = 10
HASH_BITS = 60


def sizes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, source, size, h`` of every row: words of the whole text, hash of the id."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words.alias("size"),
        hash60(F.col(key), "mix:").alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: one row per source, budgets filled up like water levels.

    Each round asks Spark for two sums; a round that caps no further source is the last.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sorted_ordinal(cut(sums), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = cut(
        ranked.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, None, -1
    full = F.lit(False)
    while True:
        row = ranked.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (budget - row["held"]) / row["open"]
        full = full | (F.col("weight") * F.lit(level) > F.col("cap"))
    poured = F.lit(0.0) if level is None else F.col("weight") * F.lit(level)
    return ranked.select("source", "source_size", F.least(poured, F.col("cap").cast("double")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame, bits: int = BITS) -> DataFrame:
    """``source, source_size, target, times, below``: whole passes, and the hash limit of the rest.

    ``below`` is the limit whose hash group ends nearest to the rest of the budget (the smaller one
    if two are equally near). ``sized`` should be a stored table: each round reads it once more and
    sums only the rows of the boundary buckets.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("times", times).select(
        "source",
        "source_size",
        "target",
        "times",
        (F.col("target") - F.col("times") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("taken"),
        F.lit(None).cast("long").alias("below"),
    )
    state = cut(state)
    shift = HASH_BITS
    while True:
        step = min(bits, shift)
        at = shift
        shift -= step
        rows = sized
        if at < HASH_BITS:  # only boundary buckets that still hold several hash values
            edge = state.where(F.col("below").isNull()).select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            same = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", at) == F.col("p"))
            rows = sized.join(edge, same, "left_semi")
        counts = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last")
        )
        state = cut(_refined(state, counts, shift))
        if state.where(F.col("below").isNull()).isEmpty():
            return state.select("source", "source_size", "target", "times", "below")


def _refined(state: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """Move every open source into the bucket where its budget runs out, or fix its limit there."""
    open_, done = state.where(F.col("below").isNull()), state.where(F.col("below").isNotNull())
    counts = counts.withColumnRenamed("source", "s")
    rows = open_.drop("prefix").join(counts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # at most 2^BITS buckets of a source and round
    order = W.partitionBy("source").orderBy("bucket")
    until = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) + F.col("taken")
    rows = rows.withColumn("until", until).withColumn("over", F.col("until") > F.col("rest"))
    found = rows.groupBy("source").agg(
        *(F.first(c).alias(c) for c in ("source_size", "target", "times", "rest")),
        F.min(F.when(F.col("over"), F.struct("bucket", "size", "until", "first", "last"))).alias("b"),
        F.first("taken").alias("before"),
    )
    start = F.shiftleft(F.col("b.bucket"), shift)
    taken = F.col("b.until") - F.col("b.size")
    nearer = (F.col("b.until") - F.col("rest")) < (F.col("rest") - taken)
    below = F.when(F.col("b").isNull(), F.lit((1 << HASH_BITS)).cast("long")).when(
        F.col("b.first") == F.col("b.last"), F.when(nearer, F.col("b.last") + 1).otherwise(start)
    )
    moved = found.select(
        "source",
        "source_size",
        "target",
        "times",
        "rest",
        F.coalesce(F.col("b.bucket"), F.lit(0)).cast("long").alias("prefix"),
        F.coalesce(taken, F.col("before")).cast("long").alias("taken"),
        below.alias("below"),
    )
    return moved.unionByName(done)


def copies() -> Column:
    """How many times a row is taken, from its hash and its source's limits."""
    return F.col("times") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row of ``docs``."""
    sized = cut(sizes(docs))
    limits = thresholds(sized, targets(sized, weights, share, most)).withColumnRenamed("source", "s")
    rows = sized.join(limits, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once, or repeated up to ``most`` times.

    The limits come from the sizes alone; the texts are then filtered and repeated where they lie.
    """
    sized = cut(sizes(docs))
    limits = thresholds(sized, targets(sized, weights, share, most)).select(F.col("source").alias("s"), "times", "below")
    # rows travel as one struct, so that their columns cannot clash with those of the limits
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        hash60(F.col("doc_id"), "mix:").alias("h"),
        F.col("source").cast("string").alias("source"),
    ).join(limits, F.col("source").eqNullSafe(F.col("s")))
    taken = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(F.col("turn") <= copies())
    return taken.select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (
  SELECT *, 2 * source_size AS cap,
         ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM k),
e AS (SELECT *, w * ((1.5 * (SELECT sum(source_size) FROM s) - held) / open) > cap AS capped FROM c),
v AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) FILTER (capped), 0)) / sum(w) FILTER (NOT capped) AS level
  FROM e),
t AS (SELECT source, source_size, least(w * (SELECT level FROM v), cap)::DOUBLE AS target FROM e),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (
  SELECT d.*, source_size, target, times, target - times * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until,
         sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (times + CASE WHEN until <= rest OR (until - same <= rest AND until - rest < rest - (until - same))
                            THEN 1 ELSE 0 END) AS taken
FROM r
"""

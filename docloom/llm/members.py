"""Joins of a large table with a set of ids, without moving the rows that cannot match.

``only`` and ``without`` first look ids up in a bitmap of fixed size (2^24 bits, at most 262,144
rows of 16 bytes, which is the proven bound of the broadcast). Rows whose bit is clear are decided
at once; only the others are shuffled to be compared exactly. A set so large that it fills the
bitmap costs an ordinary shuffle join; the result is the same.

``components`` labels connected components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut

BITMAP_BITS = 24


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS))


def _bitmap(ids: DataFrame, key: str) -> DataFrame:
    bit = _bit(F.col(key))
    return ids.groupBy(F.shiftright(bit, 6).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("_bits")
    )


def _split(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be in ``ids``, and those whose id is surely not."""
    # rows travel as one struct, so that their columns cannot clash with those of the lookup
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{key}`").alias("key"))
    bit = _bit(F.col("key"))
    set_ = F.call_function("shiftright", F.col("_bits"), bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    marked = rows.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(_bitmap(ids, key)), "_word", "left")
    may = F.coalesce(set_, F.lit(False)) & F.col("key").isNotNull()
    return marked.where(may).select("row.*"), marked.where(~may).select("row.*")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column, ``key``, repeated or not)."""
    return _split(df, ids, key)[0].join(ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``; rows with a null key stay."""
    may, not_in = _split(df, ids, key)
    return not_in.unionByName(may.join(ids, key, "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges(a, b)``.

    Each round is a constant number of shuffles of the edges, stored in the shared folder; the
    number of rounds grows with the logarithm of the longest path. A hot node's edges are reduced
    before the shuffle (``min``), and joined by a join that adaptive execution may split.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = cut(
            small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

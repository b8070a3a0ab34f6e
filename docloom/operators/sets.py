"""Set operators over installed files, required keys and field lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ordered import top_k


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def without_excluded(df: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """Rows whose path is none of the excluded files or below an excluded folder."""
    for prefix in prefixes:
        df = df.filter(~F.startswith(F.col(path), F.lit(prefix)))
    return df


def stale_paths(previous: DataFrame, new: DataFrame) -> DataFrame:
    return previous.subtract(new)


def intent_paths(previous: DataFrame, new: DataFrame) -> DataFrame:
    return previous.unionByName(new).distinct()


def install_conflicts(new: DataFrame, existing: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """Targets that exist already and were not put there by an earlier install."""
    return new.join(existing.select(key), key, "left_semi").join(known.select(key), key, "left_anti")


def removable(recorded: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    return recorded.join(existing.select(key), key, "left_semi")


def field_mismatch(a: Column, b: Column) -> Column:
    """Fields in exactly one of two field lists, sorted."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def count_by_section(manifest: DataFrame) -> DataFrame:
    """Paths per folder and section, with folder totals (``section`` null)."""
    counted = manifest.groupBy("dir", "section").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("incomplete").alias("incomplete")
    )
    totals = counted.groupBy("dir").agg(F.sum("n").alias("n"), F.bool_or("incomplete").alias("incomplete"))
    return counted.unionByName(totals.withColumn("section", F.lit(None).cast("string")))


def sample_with_more(df: DataFrame, by: str, value: str, k: int = 5) -> DataFrame:
    """First ``k`` distinct values per group, sorted, and how many more there are."""
    distinct = df.select(by, value).distinct()
    first = top_k(distinct, [by], [F.col(value)], k).groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("_list"))
    counts = distinct.groupBy(by).agg(F.count(F.lit(1)).alias("n_values"))
    more = F.col("n_values") - k
    text = F.array_join("_list", ", ")
    return first.join(counts, by).select(
        by,
        "n_values",
        F.when(more > 0, F.concat(text, F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise(text).alias("sample"),
    )


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def position_in(column: Column, order: list[str]) -> Column:
    """Place of a value in a fixed list (from 0); unknown values come last."""
    found = F.array_position(F.array(*[F.lit(v) for v in order]), column)
    return F.when(F.coalesce(found, F.lit(0)) == 0, F.lit(len(order))).otherwise(found - 1).cast("bigint")

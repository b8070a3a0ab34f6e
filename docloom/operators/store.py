"""Keyed result store kept as immutable Parquet files (full snapshots and changes), and lookups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.costs import age_seconds

STORE_SCHEMA = (
    "key string, category string, breaking boolean, breaking_reason string, model string, effort string, "
    "prompt_version string, release string, text string, classified_at timestamp"
)
SCHEMA_VERSION = 1


# -- set logic -----------------------------------------------------------------


def latest_rows(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The row with the highest ``order`` per key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select("_row.*")


def upsert(store: DataFrame, new: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """Insert or replace by key: a new row replaces all columns of the stored one.

    With ``order`` the highest value wins inside ``new``; the column is then left out.
    """
    columns = store.columns
    latest = new if order is None else latest_rows(new, key, order, columns)
    kept = store.join(latest.select(key), key, "left_anti")
    return kept.select(*columns).unionByName(latest.select(*columns))


def rows_for_keys(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key), key, "left_semi")


def source_fallback(primary: DataFrame, secondary: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Per key the primary row, else the secondary one, and which it was."""
    a = primary.select(key, F.struct(*values).alias("_a"))
    b = secondary.select(key, F.struct(*values).alias("_b"))
    both = a.join(b, key, "full_outer")
    chosen = F.coalesce("_a", "_b")
    return both.select(
        key,
        *[chosen[v].alias(v) for v in values],
        F.when(F.col("_a").isNotNull(), F.lit("primary")).otherwise(F.lit("secondary")).alias("how"),
    )


def freshest_snapshot(
    cached: DataFrame, refetched: DataFrame, now: Column, ttl_s: float | None, key: str = "url"
) -> DataFrame:
    """Per URL: the cached copy while young enough, else the refetched one, else the stale one.

    ``cached`` holds (url, fetched_at, body); ``refetched`` also ``ok``. No TTL: never expires.
    """
    old = cached.groupBy(key).agg(F.max_by(F.struct("fetched_at", "body"), "fetched_at").alias("_old"))
    fresh = (
        refetched.filter("ok").groupBy(key).agg(F.max_by(F.struct("fetched_at", "body"), "fetched_at").alias("_new"))
    )
    young = F.lit(True) if ttl_s is None else age_seconds(now, F.col("_old.fetched_at")) <= ttl_s
    keep = F.col("_old").isNotNull() & F.coalesce(young, F.lit(False))
    how = (
        F.when(keep, F.lit("cached"))
        .when(F.col("_new").isNotNull(), F.lit("refetched"))
        .otherwise(F.lit("stale"))
    )
    both = old.join(fresh, key, "full_outer").withColumn("how", how)
    chosen = F.when(F.col("how") == "refetched", F.col("_new")).otherwise(F.col("_old"))
    return both.select(key, chosen["fetched_at"].alias("fetched_at"), chosen["body"].alias("body"), "how")


def fingerprint(parser_version: str, key: Column, payload: Column) -> Column:
    digest = F.sha2(F.concat_ws("\n", F.lit(parser_version), key.cast("string"), payload), 256)
    return F.coalesce(digest, F.lit(""))  # declared non-null, see ``text.result_key``


def cache_split(df: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Add ``hit``: the cached row carries the fingerprint this input has now."""
    known = cached.select(key, "fingerprint").distinct().withColumn("hit", F.lit(True))
    return df.join(known, [key, "fingerprint"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def through_cache(df: DataFrame, cached: DataFrame, key: str, compute) -> DataFrame:
    """Cached results where the fingerprint matches, ``compute(missing)`` for the rest."""
    match = [key, "fingerprint"]
    hits = cached.join(df.select(*match), match, "left_semi")
    missing = df.join(cached.select(*match), match, "left_anti")
    return hits.unionByName(compute(missing))


def run_progress(outcomes: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run, how many results were stored, saved, printed or are still missing."""
    return outcomes.groupBy(by).pivot("status", ["stored", "saved", "printed", "missing"]).agg(
        F.count(F.lit(1))
    ).na.fill(0)


def validate_rows(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Split on a caller's check: ``reason`` is null for a good row, else says what is wrong."""
    checked = df.withColumn("reason", reason)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


# -- stored files --------------------------------------------------------------
# A store is a folder of numbered writes. A write is a full snapshot or only the changed rows;
# a row in ``commits`` makes it visible. Reading starts at the newest full snapshot and lets
# the newest row of each key win, so an upsert costs as much as its rows, not as the store.

_COMMITS = "version bigint, schema_version int, is_full boolean"
COMPACT_AFTER = 16


def _visible(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the writes a reader needs, oldest first (at most ``COMPACT_AFTER`` + 1)."""
    try:
        log = spark.read.schema(_COMMITS).parquet(f"{root}/commits")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    ends = log.agg(F.max("schema_version").alias("layout"), F.max(F.when(F.col("is_full"), F.col("version"))).alias("full")).first()
    if ends.layout is not None and ends.layout > SCHEMA_VERSION:
        raise ValueError(f"{root} was written with layout {ends.layout}, newer than {SCHEMA_VERSION}")
    return sorted(row.version for row in log.filter(F.col("version") >= (ends.full or 0)).select("version").distinct().collect())


def latest_version(spark: SparkSession, root: str) -> int:
    """Newest committed write, 0 when there is none; refuses a newer layout."""
    return max(_visible(spark, root), default=0)


def read_snapshot(spark: SparkSession, root: str, schema: str = STORE_SCHEMA, key: str = "key") -> DataFrame:
    versions = _visible(spark, root)
    if not versions:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/data/version={v}" for v in versions]
    rows = spark.read.schema(f"{schema}, version bigint").option("basePath", f"{root}/data").parquet(*paths)
    columns = [name for name in rows.columns if name != "version"]
    return rows.select(*columns) if len(versions) == 1 else latest_rows(rows, key, "version", columns)


def _commit(df: DataFrame, root: str, is_full: bool) -> int:
    spark = df.sparkSession
    version = latest_version(spark, root) + 1
    df.write.mode("overwrite").parquet(f"{root}/data/version={version}")
    row = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(is_full).alias("is_full")
    )
    row.write.mode("append").parquet(f"{root}/commits")
    return version


def commit_snapshot(df: DataFrame, root: str) -> int:
    """Write ``df`` as the whole store."""
    return _commit(df, root, is_full=True)


def commit_changes(df: DataFrame, root: str, schema: str = STORE_SCHEMA, key: str = "key") -> int:
    """Write inserted and replaced rows (one per key); now and then the store is compacted."""
    spark = df.sparkSession
    if len(_visible(spark, root)) > COMPACT_AFTER:
        commit_snapshot(read_snapshot(spark, root, schema, key), root)
    return _commit(df, root, is_full=False)


def stored_keys(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, root).select("key").distinct()

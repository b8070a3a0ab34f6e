"""Structured Streaming jobs. Each reads files as they arrive and ends at a table.

State that must outlive a micro-batch is a snapshot table in the shared folder, changed by the
same DataFrame operators as the batch twins, so a hot key is spread like in batch. A replayed
micro-batch is recognised by its number and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import result_key
from docloom.operators import ledger, scoring, store
from docloom.operators.metrics import SKETCH_K, sketch_quantile
from docloom.session import scratch_path
from docloom.sources.files import number_lines, parse_lines


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all files present, micro-batch by micro-batch, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


class StateTable:
    """Snapshots of a table numbered by micro-batch: batch ``n`` reads ``n - 1``, writes ``n``."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root, schema

    def before(self, epoch: int) -> DataFrame:
        if epoch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/epoch={epoch - 1}")

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}")


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a table (a folder, or one file) as a stream."""
    schema = spark.read.parquet(path).schema
    # A pattern that matches only this path: the file source refuses the plain name of one file.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


# -- store ingestion -----------------------------------------------------------


def ingest_drop_folder(spark: SparkSession, folder: str, root: str, checkpoint: str) -> None:
    """Take every dropped JSON-lines file once: good rows are upserted, bad lines reported.

    The files stay where they are; the checkpoint remembers which were taken. Importing one
    again changes nothing, since a row replaces itself.
    """
    lines = spark.readStream.format("text").load(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at")
    )

    def take(batch: DataFrame, epoch: int) -> None:
        good, bad = parse_lines(number_lines(batch))
        store.commit_changes(store.latest_rows(good, "key", "classified_at", good.columns), root)
        bad.write.mode("overwrite").parquet(f"{root}/rejected/epoch={epoch}")

    run_available(lines, take, checkpoint)


def score_once(stream: DataFrame, root: str, checkpoint: str, settings: tuple[str, str, str]) -> None:
    """Score each distinct text once, ever: new keys are those the store does not hold."""
    spark = stream.sparkSession

    def take(batch: DataFrame, epoch: int) -> None:
        version, model, effort = settings
        keyed = batch.withColumn("key", result_key(F.lit(version), F.lit(model), F.lit(effort), F.col("text")))
        first = keyed.groupBy("key").agg(F.min_by("text", "ord").alias("text"), F.min_by("release", "ord").alias("release"))
        fresh = scoring.rule_scores(first.join(store.stored_keys(spark, root), "key", "left_anti"))
        rows = fresh.select(
            "key", "category", "breaking", "breaking_reason", F.lit(model).alias("model"), F.lit(effort).alias("effort"),
            F.lit(version).alias("prompt_version"), "release", "text", F.timestamp_seconds(F.lit(0)).alias("classified_at"),
        )
        store.commit_changes(rows, root)

    run_available(stream, take, checkpoint)


# -- attempts ------------------------------------------------------------------

_BUDGET = "run_id bigint, start_us bigint, requests bigint, out_sum bigint, in_sum bigint, stopped boolean"


def budget_ledger(stream: DataFrame, out: str, checkpoint: str, caps: dict) -> None:
    """Admit or refuse attempts as they arrive; the committed sums of each run are carried on."""
    state = StateTable(stream.sparkSession, f"{out}/state", _BUDGET)

    def take(batch: DataFrame, epoch: int) -> None:
        carried = state.before(epoch)
        decided = ledger.admit_under_caps(batch, **caps, carried=carried)
        decided.write.mode("overwrite").parquet(f"{out}/decisions/epoch={epoch}")
        rows = stream.sparkSession.read.schema(decided.schema).parquet(f"{out}/decisions/epoch={epoch}")
        kept = F.col("admitted")
        sums = rows.groupBy("run_id").agg(
            F.min("ts_us").alias("start_us"),
            F.count_if(kept & F.col("is_attempt")).alias("requests"),
            F.coalesce(F.sum(F.when(kept, F.col("out_delta"))), F.lit(0)).alias("out_sum"),
            F.coalesce(F.sum(F.when(kept, F.col("in_delta"))), F.lit(0)).alias("in_sum"),
            F.bool_or(~kept).alias("stopped"),
        )
        merged = carried.unionByName(sums).groupBy("run_id").agg(
            F.min("start_us").alias("start_us"), F.sum("requests").alias("requests"), F.sum("out_sum").alias("out_sum"),
            F.sum("in_sum").alias("in_sum"), F.bool_or("stopped").alias("stopped"),
        )
        state.write(merged, epoch)

    run_available(stream, take, checkpoint)


_PENDING = "user_id bigint, event_id bigint, ts_us bigint, kind string"


def orphan_timeout(stream: DataFrame, out: str, checkpoint: str, within_us: int) -> None:
    """Emit claims not finished within the limit, once the newest event is past it.

    ``stream``: (user_id, event_id, ts_us, kind claim/finish, any other kind only moves the clock).
    Open claims, the finishes that may still meet one, and the newest time are carried to the next
    micro-batch. A claim may come up to the limit late and still meet its finish.
    """
    state = StateTable(stream.sparkSession, f"{out}/state", _PENDING)

    def take(batch: DataFrame, epoch: int) -> None:
        rows = state.before(epoch).unionByName(batch.select("user_id", "event_id", "ts_us", "kind"))
        newest = rows.agg(F.max("ts_us")).scalar()
        due = F.col("ts_us") + within_us < newest
        claims = rows.filter("kind = 'claim'")
        finishes = rows.filter("kind = 'finish'")
        orphans = ledger.unfinished_claims(claims.filter(due), finishes, "user_id", within_us)
        orphans.select("user_id", "event_id", "ts_us").write.mode("overwrite").parquet(f"{out}/orphans/epoch={epoch}")
        waiting = claims.filter(~due)
        recent = finishes.filter(F.col("ts_us") + 2 * within_us >= newest)
        nobody = F.lit(None).cast("bigint")
        clock = rows.agg(F.max("ts_us").alias("ts_us")).select(
            nobody.alias("user_id"), nobody.alias("event_id"), "ts_us", F.lit("clock").alias("kind")
        )
        kept = waiting.unionByName(recent).select("user_id", "event_id", "ts_us", "kind")
        state.write(kept.unionByName(clock.filter("ts_us is not null")), epoch)

    run_available(stream, take, checkpoint)


def stop_reasons(stream: DataFrame, out: str, checkpoint: str) -> None:
    """First error of each run: a streaming aggregate whose changed rows are logged per batch."""
    firsts = stream.filter(F.col("reason").isNotNull()).groupBy("run_id").agg(
        F.min("ts_us").alias("ts_us"), F.min(F.struct("ts_us", "reason"))["reason"].alias("reason")
    )
    run_available(firsts, _log_batch(out), checkpoint, mode="update")


def read_stop_reasons(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("run_id").agg(
        F.min("ts_us").alias("ts_us"), F.min(F.struct("ts_us", "reason"))["reason"].alias("reason")
    )


def latest_fetches(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Newest successful fetch per URL, changed rows logged per batch; whether it has expired is
    decided on reading."""
    newest = stream.filter("ok").groupBy("url").agg(
        F.max("fetched_us").alias("fetched_us"), F.max_by("body", "fetched_us").alias("body")
    )
    run_available(newest, _log_batch(out), checkpoint, mode="update")


def read_fetches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("url").agg(
        F.max("fetched_us").alias("fetched_us"), F.max_by("body", "fetched_us").alias("body")
    )


def _log_batch(out: str) -> Callable[[DataFrame, int], None]:
    """Write a batch under its number: a replay replaces it, and nothing else is rewritten."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def with_expiry(latest: DataFrame, now_us: Column, ttl_us: int) -> DataFrame:
    return latest.withColumn("expired", now_us - F.col("fetched_us") > ttl_us)


# -- latency windows -----------------------------------------------------------


def latency_histogram(stream: DataFrame, out: str, checkpoint: str, window: str, delay: str) -> None:
    """Counts of each value per time window and type, late rows dropped, appended once final.

    The state is one counter per distinct value, so a busy window stays a sum of partial
    counts; exact percentiles are read from the written histogram.
    """
    counts = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "event_type", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "value", "n")
    )
    query = (
        counts.writeStream.outputMode("append")
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .format("parquet")
        .option("path", out)
        .start()
    )
    query.awaitTermination()


def latency_sketches(stream: DataFrame, out: str, checkpoint: str, window: str, delay: str, k: int = SKETCH_K) -> list[dict]:
    """Count and quantile sketch per time window and type, late rows dropped, appended once final.

    The state is one row of bounded size per open window and type, however many rows arrive. Returns
    the progress of each micro-batch.
    """
    sketches = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("value").cast("double"), k).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "sketch")
    )
    query = (
        sketches.writeStream.outputMode("append")
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .format("parquet")
        .option("path", out)
        .start()
    )
    query.awaitTermination()
    return [json.loads(progress.json) for progress in query.recentProgress]


def read_latency_windows(spark: SparkSession, out: str, failed: str, prob: float = 0.95) -> DataFrame:
    """``window_start, requests, errors, p95`` of the final windows: the sketches of all types merged."""
    errors = F.coalesce(F.sum(F.when(F.col("event_type") == failed, F.col("n"))), F.lit(0))
    return spark.read.parquet(out).groupBy("window_start").agg(
        F.sum("n").alias("requests"), errors.alias("errors"), sketch_quantile(F.kll_merge_agg_double("sketch"), prob).alias("p95")
    )


def stream_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    """New output and checkpoint paths below the shared folder."""
    root = scratch_path(spark, label)
    return f"{root}/out", f"{root}/checkpoint"

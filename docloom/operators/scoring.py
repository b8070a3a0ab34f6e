"""Scoring of pending entries: default rules, batched pluggable scorers, name index."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.costs import BATCH_SIZE, MAX_ATTEMPTS, MAX_IN_FLIGHT, input_bound, max_tokens_for
from docloom.functions.qualified import split_qualified
from docloom.functions.text import truncate_marked
from docloom.operators.ledger import batch_payload_sizes, number_batches, plan_caps
from docloom.session import cut, scratch_path

# Categories, and the words that decide between them (first match wins).
CATEGORIES = ("fixed", "added", "changed", "deprecated", "other")
RULES = (
    ("other", r"(?i)^(?:updated?|revised?|improved?) (?:the )?(?:documentation|docs|examples?|tests?)\b"),
    ("fixed", r"(?i)\b(?:fix(?:e[sd])?|bugs?|crash(?:e[sd])?|leak(?:s|ed)?|race|warnings?|errors?)\b"),
    ("deprecated", r"(?i)\bdeprecat\w*"),
    ("changed", r"(?i)\b(?:remov\w+|renam\w+|moved?|default|improv\w+|optimi[sz]\w+|chang\w+)\b"),
    ("added", r"(?i)\b(?:add(?:s|ed)?|new|support(?:s|ed)?)\b"),
)
BREAKING = (
    r"(?i)(?:\b(?:removed|renamed)\b.*\b(?:function|class|member|type|overload|header|macro|api)s?\b"
    r"|\bchanged\b.*\bdefault\b|\bnow requires?\b|\bminimum\b.*\b(?:raised|version)\b)"
)
SCORED_SCHEMA = (
    "key string, category string, breaking boolean, breaking_reason string, status string, reason string, attempts int"
)


# -- default scorer ------------------------------------------------------------


def rule_category(text: Column) -> Column:
    chosen = F.lit("other")
    for name, pattern in reversed(RULES):
        chosen = F.when(text.rlike(pattern), F.lit(name)).otherwise(chosen)
    return chosen


def rule_breaking(text: Column) -> Column:
    return text.rlike(BREAKING)


def rule_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Deterministic keyword scorer: an approximation of a model, never equal to one."""
    broken = rule_breaking(F.col(text))
    return df.withColumn("category", rule_category(F.col(text))).withColumn("breaking", broken).withColumn(
        "breaking_reason", F.when(broken, F.lit("names a removed, renamed or changed public part")).otherwise(F.lit(""))
    )


# -- batched scorer ------------------------------------------------------------

# A scorer takes [{"id", "text"}] and returns {"stop_reason", "items": [...]}; it raises
# Retryable to be called again.
Scorer = Callable[[list[dict]], dict]


class Retryable(Exception):
    """Raised by a scorer for a failure worth another attempt."""


def _read_reply(reply: dict, ids: list[str]) -> dict | None:
    """The reply's items by id, or None unless it holds exactly the ids sent, all well formed."""
    items = reply.get("items")
    if not isinstance(items, list) or len(items) != len(ids):
        return None
    found = {}
    for item in items:
        good = isinstance(item, dict) and {"id", "category", "breaking", "breaking_reason"} <= item.keys()
        if not good or item["category"] not in CATEGORIES or not isinstance(item["breaking"], bool):
            return None
        found[item["id"]] = item
    return found if found.keys() == set(ids) else None


class _Batch:
    """Outcome of one batch: rows so far, calls made, keys sent, tokens, and the first failure.

    ``allowed`` calls may be made; a batch that needs more is ``short``. Each call reserves
    ``reserved`` (input, output) tokens. What a reply reports instead is settled; a reply without
    usage, and a failed call, may have cost all that was reserved.
    """

    def __init__(self, scorer: Scorer, allowed: int | None = None, reserved: tuple[int, int] = (0, 0)) -> None:
        self.scorer, self.calls, self.failure, self.rows, self.sent = scorer, 0, None, {}, set()
        self.allowed, self.reserved, self.short, self.overrun = allowed, reserved, False, False
        self.tokens = [0, 0]

    def settle(self, reply: dict | None) -> None:
        usage = (reply or {}).get("usage") or {}
        for k, name in enumerate(("input_tokens", "output_tokens")):
            billed = usage.get(name, self.reserved[k])
            self.tokens[k] += billed
            self.overrun |= billed > self.reserved[k]

    def call(self, items: list[dict]) -> dict | None:
        for attempt in range(MAX_ATTEMPTS):
            if self.calls == self.allowed:
                self.short, self.failure = True, "request cap reached"
                return None
            self.calls += 1
            reply = None
            try:
                reply = self.scorer(items)
                return reply
            except Retryable as error:
                if attempt + 1 == MAX_ATTEMPTS:
                    self.failure = f"{error} (after {MAX_ATTEMPTS} attempts)"
            except Exception as error:  # what is already paid for must not be lost with the task
                self.failure = f"{type(error).__name__}: {error}"
                return None
            finally:
                self.settle(reply)
        return None

    def outcome(self, keyed: list[tuple[str, str]]) -> list[tuple]:
        """A row per key: key, category, breaking, breaking_reason, status, reason, attempts."""
        out = []
        for key, _ in keyed:
            row = self.rows.get(key)
            if row is not None:
                out.append((key, row["category"], row["breaking"], str(row["breaking_reason"]), "ok", None, self.calls))
            else:
                out.append((key, None, None, None, "failed" if key in self.sent else "skipped", self.failure, self.calls))
        return out

    def score(self, keyed: list[tuple[str, str]], may_split: bool = True) -> None:
        if self.failure:
            return
        items = [{"id": f"e{i}", "text": text} for i, (_, text) in enumerate(keyed)]
        ids = [item["id"] for item in items]
        self.sent.update(key for key, _ in keyed)
        for resend in (False, True):
            reply = self.call(items)
            if reply is None:
                return
            stop = reply.get("stop_reason")
            if stop == "max_tokens":
                if resend or not may_split or len(keyed) == 1:
                    self.failure = "output limit hit"
                    return
                half = len(keyed) // 2
                self.sent.difference_update(key for key, _ in keyed)  # each half is sent anew
                self.score(keyed[:half], may_split=False)
                self.score(keyed[half:], may_split=False)
                return
            if stop == "refusal":
                self.failure = "refused"
                return
            parsed = _read_reply(reply, ids)
            if parsed is not None:
                self.rows.update({key: parsed[i] for i, (key, _) in zip(ids, keyed)})
                return
        self.failure = "invalid reply twice"


def score_entries(
    pending: DataFrame,
    scorer: Scorer | None = None,
    order: str = "ord",
    size: int = BATCH_SIZE,
    max_parallel: int | None = MAX_IN_FLIGHT,
    max_requests: int | None = None,
    stop_on_failure: bool = False,
    shorten: bool = False,
) -> DataFrame:
    """Score distinct (key, text) rows in batches; rows say ``ok``, ``failed`` or ``skipped``.

    Without a scorer the keyword rules are applied as column expressions. Otherwise one batch is
    one row (at most ``size`` texts), so a failed batch never loses another's results and a rerun
    scores only what is still missing. A key that was sent and has no result is ``failed``; one
    that was never sent is ``skipped``.

    ``max_requests`` is a cap for the run: batches past it are skipped before anything is sent.
    ``stop_on_failure`` skips the batches that a task holds after a failed one. ``max_parallel``
    bounds the tasks that call a rate-limited scorer. ``shorten`` sends long texts cut and marked.
    """
    if scorer is None:
        done = rule_scores(pending.select("key", "text"))
        return done.select(
            "key", "category", "breaking", "breaking_reason", F.lit("ok").alias("status"),
            F.lit(None).cast("string").alias("reason"), F.lit(0).alias("attempts"),
        )
    batched = number_batches(pending.select("key", "text", order), order, size)
    text = truncate_marked(F.col("text")) if shorten else F.col("text")
    rows = batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("place", "key", text.alias("text")))).alias("items"))
    over = F.lit(False) if max_requests is None else F.col("batch_id") >= max_requests
    rows = rows.withColumn("over", over)
    if max_parallel is not None:
        rows = rows.repartition(max_parallel, "batch_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for frame in frames:
            out = []
            for items, over in zip(frame["items"], frame["over"]):
                keyed = [(item["key"], item["text"]) for item in items]
                batch = _Batch(scorer)
                if over:
                    batch.failure = "request cap reached"
                elif stopped:
                    batch.failure = f"stopped after: {stopped}"
                else:
                    batch.score(keyed)
                    if stop_on_failure:
                        stopped = batch.failure
                out += batch.outcome(keyed)
            yield pd.DataFrame(
                out, columns=["key", "category", "breaking", "breaking_reason", "status", "reason", "attempts"]
            )

    return rows.select("items", "over").mapInPandas(run, SCORED_SCHEMA)


# -- runs under hard caps ----------------------------------------------------------


@dataclass(frozen=True)
class Caps:
    """What one run may use at most; see ``ledger.plan_caps``."""

    max_requests: int
    max_output: int
    max_input: int
    time_limit_s: float = float("inf")


# Batches sent between two settlements, and the most calls that one batch can need: three attempts, then
# either the same once more, or two halves of twice three.
WAVE_BATCHES = 64 * MAX_IN_FLIGHT
CALLS_PER_BATCH = 5 * MAX_ATTEMPTS
_WAVE_SCHEMA = (
    "batch_id long, calls int, input_tokens long, output_tokens long, short boolean, overrun boolean, failure string, "
    "rows array<struct<key:string,category:string,breaking:boolean,breaking_reason:string,status:string,reason:string,attempts:int>>"
)


def planned_caps(pending: DataFrame, order: str, size: int = BATCH_SIZE, time_limit_s: float = float("inf")) -> Caps:
    """The caps that ``ledger.plan_caps`` sets for scoring ``pending``."""
    batched = number_batches(pending.select("key", "text", order), order, size)
    plan = plan_caps(batch_payload_sizes(batched, F.col("text"))).first()
    return Caps(plan["max_requests"], plan["max_output"], plan["max_input"], time_limit_s)


def score_in_waves(
    pending: DataFrame,
    scorer: Scorer,
    caps: Caps,
    order: str = "ord",
    size: int = BATCH_SIZE,
    wave: int = WAVE_BATCHES,
    max_parallel: int = MAX_IN_FLIGHT,
    stop_on_failure: bool = False,
    clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """:func:`score_entries` for a scorer that costs money: a run that stops as a whole at its caps.

    The batches go out in waves. Before a wave is sent, all calls that its batches may make are reserved;
    a batch that would pass a cap is not sent. The tasks write what they did, reported usage replaces
    the reservations, and the next wave starts from there. So no cap is ever passed, whatever the
    scorer reports, and these end the run: a cap, the time limit, a reply above its reservation (the
    bounds hold no more), and with ``stop_on_failure`` a failed batch. Batches not sent by then are
    ``skipped`` with the reason. A batch that ran out of its calls goes into the next wave again.

    The driver sees sums of a wave, never its rows. A wave is written once; lost tasks are repeated
    before it is settled.
    """
    spark = pending.sparkSession
    batched = number_batches(pending.select("key", "text", order), order, size)
    text = F.struct("place", "key", "text")
    queue = batched.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(text)).alias("items"), F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("text")).alias("bytes")
    )
    queue = cut(queue.select("batch_id", "items", max_tokens_for(F.col("entries")).alias("out"), input_bound(F.col("bytes")).alias("in")))
    # waves are chosen by these numbers alone: a task that sorts or sums them holds no texts
    numbers = queue.select("batch_id", "out", "in")
    root = scratch_path(spark, "waves")
    requests = used_out = used_in = waves = 0
    deadline, stop = clock() + caps.time_limit_s, None

    def sent() -> DataFrame:
        if not waves:
            return spark.createDataFrame([], _WAVE_SCHEMA)
        return spark.read.schema(_WAVE_SCHEMA).parquet(*(f"{root}/wave={k}" for k in range(waves)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for batch_id, items, allowed, room in zip(frame["batch_id"], frame["items"], frame["allowed"], zip(frame["in"], frame["out"])):
                keyed = [(item["key"], item["text"]) for item in items]
                batch = _Batch(scorer, int(allowed), (int(room[0]), int(room[1])))
                batch.score(keyed)
                rows = [] if batch.short else batch.outcome(keyed)
                out.append((batch_id, batch.calls, *batch.tokens, batch.short, batch.overrun, batch.failure, rows))
            columns = ["batch_id", "calls", "input_tokens", "output_tokens", "short", "overrun", "failure", "rows"]
            yield pd.DataFrame(out, columns=columns)

    while True:
        done_ids = sent().where("not short").select("batch_id")
        left = numbers.join(done_ids, "batch_id", "left_anti")
        head = left.orderBy("batch_id").limit(wave)
        n = head.count()
        if stop or not n:
            break
        if clock() >= deadline:
            stop = "time limit"
        elif requests >= caps.max_requests:
            stop = "max_requests"
        if stop:
            break
        free = caps.max_requests - requests
        # all calls still free, dealt evenly; at most what a batch can need
        allowed = max(1, min(CALLS_PER_BATCH, free // min(n, free)))
        # the rows of one wave
        so_far = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
        upto = {c: F.sum(c).over(so_far) for c in ("out", "in")}
        placed = head.withColumns({"_n": F.row_number().over(W.orderBy("batch_id")), **{f"_{c}": x for c, x in upto.items()}})
        for calls in (allowed, 1):
            fits = f"_n * {calls} <= {free} and _out * {calls} <= {caps.max_output - used_out} and _in * {calls} <= {caps.max_input - used_in}"
            chosen = cut(placed.where(fits).withColumn("allowed", F.lit(calls)).select("batch_id", "allowed"))
            if not chosen.isEmpty():
                break
        else:
            first = head.first()
            stop = "max_output" if first["out"] > caps.max_output - used_out else "max_input"
            break
        tasks = queue.join(chosen, "batch_id").repartition(max_parallel, "batch_id").mapInPandas(run, _WAVE_SCHEMA)
        tasks.write.parquet(f"{root}/wave={waves}")
        waves += 1
        done = spark.read.schema(_WAVE_SCHEMA).parquet(f"{root}/wave={waves - 1}").agg(
            F.sum("calls").alias("calls"), F.sum("output_tokens").alias("out"), F.sum("input_tokens").alias("in"),
            F.bool_or("overrun").alias("overrun"), F.min(F.when(~F.col("short"), F.col("failure"))).alias("failure"),
        ).first()
        requests, used_out, used_in = requests + done["calls"], used_out + done["out"], used_in + done["in"]
        if done["overrun"]:
            stop = "usage above its reservation"
        elif stop_on_failure and done["failure"] is not None:
            stop = done["failure"]
    finished = sent().where("not short").select(F.explode("rows").alias("r")).select("r.*")
    skipped = queue.join(done_ids, "batch_id", "left_anti").select(F.explode("items").alias("i")).select(
        F.col("i.key").alias("key"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("boolean").alias("breaking"),
        F.lit(None).cast("string").alias("breaking_reason"), F.lit("skipped").alias("status"), F.lit(f"run stopped: {stop}").alias("reason"),
        F.lit(0).alias("attempts"),
    )
    return finished.unionByName(skipped)


def keyword_scorer(items: list[dict]) -> dict:
    """The keyword rules as a batch scorer, for tests of the protocol."""
    scored = []
    for item in items:
        category = next((name for name, pattern in RULES if re.search(pattern, item["text"])), "other")
        breaking = re.search(BREAKING, item["text"]) is not None
        scored.append({
            "id": item["id"], "category": category, "breaking": breaking,
            "breaking_reason": "names a removed, renamed or changed public part" if breaking else "",
        })
    return {"stop_reason": "end_turn", "items": scored}


# -- names ---------------------------------------------------------------------

def name_index(titles: DataFrame, title: str = "title") -> DataFrame:
    """Number of distinct titles below every leading part of a qualified name."""
    distinct = titles.select(title).distinct().withColumn("parts", split_qualified(F.col(title)))
    leads = F.transform(
        F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "::")
    )
    return (
        distinct.filter(F.col("parts").isNotNull())
        .select(F.explode(leads).alias("prefix"))
        .groupBy("prefix")
        .agg(F.count(F.lit(1)).alias("n_titles"))
    )

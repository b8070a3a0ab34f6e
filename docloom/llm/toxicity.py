"""Toxicity from class-conditional Kneser-Ney models of characters.

One model of toxic and one of ordinary learning documents give every character of a text, after the
``ORDER - 1`` before it, a probability; the score is the calibrated difference of the log-likelihoods per
character, over the whole text and over its most toxic stretch. Per class c, n-gram h w and order:

    P(w | h) = max(N(h w) - D, 0) / N(h .) + D * kinds(h .) / N(h .) * P(w | h without its first character)

At the highest order N(h w) is the number of the class's documents that hold h w; below, it is the number of
different characters found before h w, as Kneser and Ney count. The orders up to ``SHARED`` are
counted over both classes together: an expression rare in either is smoothed by the same counts, and
where only they speak, the classes do not differ. At the bottom stands an equal share for every
known character and one more.

All learning documents are counted, in Spark, and every n-gram counts. What scoring needs of an n-gram is
one number for its own probabilities and one for its weight as a history, each the log of toxic over
ordinary. Up to ``GRAMS`` n-grams are sent to the tasks as a whole. More stay a table: texts are dealt
into blocks of about ``BLOCK`` characters, each block's different n-grams are joined with the
table, and a block is scored together with its part of it.

A quarter of the learning rows (by id hash) is not counted but calibrates the score.

Defined cases: a null or empty text, or one shorter than an n-gram, has difference 0; labels that are null
or without a document are not learned from; several labels of a document count as toxic if one is;
without learning rows of both classes every score is near 0 (near 1 if all rows are toxic); repeated
rows each get their row; n-grams are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc_mod, cut, hash60
from docloom.llm.decontaminate import normalised
from docloom.llm.members import only

ORDER = 5
# Orders up to this one are counted over both classes.
SHARED = 3
# Most n-grams of a model that is sent to the tasks; a larger one is joined.
GRAMS = 1 << 20
# Characters of the texts that share a part of a joined model; a longer text is a block of its own.
BLOCK = 4 << 20
DISCOUNT = 0.75
THRESHOLD = 0.7
# N-grams a task counts before it hands them on.
PENDING = 1 << 20
# Width of the stretch whose likelihood is looked at beside the whole text's, in characters.
STRETCH = 12
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """The n-grams that decide, and the calibration.

    ``grams``: keys, each one's log of its probability toxic over ordinary, and the same of the weight it
    leaves to shorter ones as a history; or they are in ``table`` (``key, own, history``) if too many to send.
    """

    grams: tuple[np.ndarray, np.ndarray, np.ndarray]
    fit: tuple[float, ...] = (0.0, 0.0, 0.0)
    table: DataFrame | None = None


def characters(text: str | None) -> np.ndarray:
    """A text in lower case without punctuation, words between spaces, as code points."""
    data = normalised(text)
    return np.frombuffer(f" {data.decode()} ".encode("utf-32-le"), "<u4").astype(np.uint64) if data else np.empty(0, np.uint64)


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all n-grams of ``size`` characters, other ones for every size; 0 stands for the empty one."""
    n = max(0, len(points) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size if n else 0):
        total = (total ^ points[k : k + n]) * _FACTOR
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


_TYPES = pa.schema([("size", pa.int32()), *((c, pa.int64()) for c in ("key", "history", "suffix", "n0", "n1"))])
_TYPES_SQL = "size int, key long, history long, suffix long, n0 long, n1 long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of all sizes, what is left without their last and first character, and how many ordinary
    and toxic documents of this task hold them."""
    held: list[list[list[np.ndarray]]] = []
    n = 0

    def made() -> Iterator[pa.RecordBatch]:
        for size in range(1, ORDER + 1):
            parts = [np.concatenate(x) for x in zip(*(own[size - 1] for own in held), strict=True)]
            keys, first, place = np.unique(parts[0], return_index=True, return_inverse=True)
            n0, n1 = (np.bincount(place, parts[3] == c, len(keys)).astype(np.int64) for c in (0, 1))
            columns = [np.full(len(keys), size), keys, parts[1][first], parts[2][first], n0, n1]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPES, strict=True)], schema=_TYPES)

    for batch in batches:
        for text, toxic in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            points = characters(text)
            if len(points) < ORDER:
                continue
            own, shorter = [], np.zeros(len(points) + 1, np.int64)
            for size in range(1, ORDER + 1):
                found = grams(points, size)
                keys, first = np.unique(found, return_index=True)
                own.append([keys, shorter[first], shorter[first + 1], np.full(len(keys), toxic)])
                shorter = found
                n += len(keys)
            held.append(own)
            if n > PENDING:
                yield from made()
                held, n = [], 0
    if held:
        yield from made()


def probabilities(learn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The Kneser-Ney models of rows ``text, toxic`` (0 or 1).

    The first table has every n-gram's ``size, key, history, suffix`` and probabilities ``p0, p1`` after
    its history; the second, per ``size`` and ``history``, the weights ``l0, l1`` left to the shorter history.
    """
    types = learn.select("text", "toxic").mapInArrow(_counted, _TYPES_SQL)
    types = cut(types.groupBy("size", "key").agg(*(F.first(c).alias(c) for c in ("history", "suffix")), *(F.sum(c).alias(c) for c in ("n0", "n1"))))
    # different characters before an n-gram, in either class and in both
    before = types.where("size > 1").groupBy((F.col("size") - 1).alias("size"), F.col("suffix").alias("key")).agg(
        *(F.count_if(F.col(f"n{c}") > 0).alias(f"b{c}") for c in (0, 1)), F.count("*").alias("b")
    )
    counts = types.join(before, ["size", "key"], "left")
    for c in (0, 1):
        number = F.when(F.col("size") == ORDER, F.col(f"n{c}")).when(F.col("size") > SHARED, F.col(f"b{c}")).otherwise(F.col("b"))
        counts = counts.withColumn(f"c{c}", F.coalesce(number, F.lit(0)))
    counts = cut(counts.select("size", "key", "history", "suffix", "c0", "c1"))
    sums = counts.groupBy("size", "history").agg(
        *(F.sum(f"c{c}").alias(f"s{c}") for c in (0, 1)), *(F.count_if(F.col(f"c{c}") > 0).alias(f"k{c}") for c in (0, 1))
    )
    left = [F.when(F.col(f"s{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"s{c}")).otherwise(1.0).alias(f"l{c}") for c in (0, 1)]
    weights = cut(sums.select("size", "history", "s0", "s1", *left))
    own = [F.when(F.col(f"s{c}") > 0, F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{c}")).otherwise(0.0).alias(f"a{c}") for c in (0, 1)]
    parts = counts.join(weights, ["size", "history"]).select("size", "key", "history", "suffix", *own, "l0", "l1")
    letters = counts.where("size = 1").count() + 1
    lower, every = None, []
    for size in range(1, ORDER + 1):
        rows = parts.where(F.col("size") == size)
        if lower is None:
            rows = rows.withColumns({"q0": F.lit(1.0 / letters), "q1": F.lit(1.0 / letters)})
        else:
            rows = rows.join(lower.select(F.col("key").alias("suffix"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "suffix")
        found = [(F.col(f"a{c}") + F.col(f"l{c}") * F.col(f"q{c}")).alias(f"p{c}") for c in (0, 1)]
        lower = cut(rows.select("size", "key", "history", "suffix", *found))
        every.append(lower)
    whole = every[0]
    for other in every[1:]:
        whole = whole.unionByName(other)
    return whole, weights.select("size", "history", "l0", "l1")


def count(learn: DataFrame, most: int = GRAMS) -> Model:
    """The model of rows ``text, toxic`` (0 or 1), without its calibration."""
    found, weights = probabilities(learn)
    # below, both classes have the same probabilities and the same weights
    own = found.where(F.col("size") > SHARED).select("key", F.log(F.col("p1") / F.col("p0")).alias("own"))
    history = weights.where(F.col("size") > SHARED).select(F.col("history").alias("key"), F.log(F.col("l1") / F.col("l0")).alias("history"))
    table = cut(own.join(history, "key", "full").select("key", *(F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("own", "history"))))
    if table.count() > most:
        return Model((np.empty(0, np.int64), np.empty(0), np.empty(0)), table=table)
    kept = table.toPandas()
    return Model(tuple(kept[c].to_numpy() for c in ("key", "own", "history")))


class Lookup:
    """Places of keys in an array, by buckets of their lowest bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.mask = np.int64((1 << bits) - 1)
        slot = keys & self.mask
        self.order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[self.order], 0)
        count = np.bincount(slot, minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(count)])
        self.most = int(count.max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, or -1."""
        slot = keys & self.mask
        low, high = self.start[slot], self.start[slot + 1]
        out = np.full(len(keys), -1)
        open_ = np.flatnonzero(low < high)
        for k in range(self.most):
            at = low[open_] + k
            good = self.keys[at] == keys[open_]
            out[open_[good]] = self.order[at[good]]
            open_ = open_[~good]
            open_ = open_[low[open_] + k + 1 < high[open_]]
            if not len(open_):
                break
        return out


class Scorer:
    """Differences of texts by the n-grams of a model."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, history: np.ndarray):
        self.lookup = Lookup(keys)
        # the last entry is that of an n-gram never counted
        self.own, self.history = np.append(own, np.nan), np.append(history, np.nan)

    def differences(self, points: np.ndarray) -> np.ndarray:
        """Per character from the ``ORDER``-th on: log-likelihood toxic less ordinary.

        The longest counted n-gram that ends here gives its own; each longer history that was counted adds
        what its weight differs.
        """
        n = max(0, len(points) - ORDER + 1)
        out = np.zeros(n)
        left = np.arange(n)  # places not decided yet, by the start of their longest n-gram
        for size in range(ORDER, SHARED, -1):
            if not len(left):
                break
            ends = left + ORDER - size
            found = self.own[self.lookup.find(grams(points, size)[ends])]
            known = ~np.isnan(found)
            out[left[known]] += found[known]
            left = left[~known]
            weight = self.history[self.lookup.find(grams(points, size - 1)[left + ORDER - size])]
            out[left] += np.where(np.isnan(weight), 0.0, weight)
        return out

    def measures(self, text: str | None) -> tuple[float, float]:
        """Difference per character of the whole text, and of its most toxic stretch."""
        d = self.differences(characters(text))
        if not len(d):
            return 0.0, 0.0
        total = np.concatenate([[0.0], np.cumsum(d)])
        width = min(STRETCH, len(d))
        return float(total[-1] / len(d)), float((total[width:] - total[:-width]).max() / width)


_MEASURES = pa.schema([("key", pa.int64()), ("mean", pa.float64()), ("stretch", pa.float64())])


def _measure_rows(scorer: Scorer, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    found = [scorer.measures(text) for text in texts.to_pylist()]
    mean, stretch = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([keys, pa.array(mean, pa.float64()), pa.array(stretch, pa.float64())], schema=_MEASURES)


def _sent(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield _measure_rows(scorer, batch.column(0), batch.column(1))

    return run


def _blocks(size: int):
    """``block, key, text``: runs of a task's rows of about ``size`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            blocks = []
            for n in pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist():
                if held and held + n > size:
                    block, held = block + 1, 0
                blocks.append(block)
                held += n
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], ["block", "key", "text"])

    return run


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, gram``: the different n-grams of each block, once per run of its rows."""

    def made() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), last, np.int64)), pa.array(keys)], ["block", "gram"])

    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        for block, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and block != last:
                yield made()
                held = []
            last = block
            points = characters(text)
            held.append(np.unique(np.concatenate([grams(points, size) for size in range(SHARED, ORDER + 1)])))
    if held:
        yield made()


def _joined(rows: DataFrame, model: Model) -> DataFrame:
    """``key, mean, stretch`` of rows ``key, text`` by a model that is a table."""
    # stored, so that every reading of a text sees the same block
    dealt = cut(rows.mapInArrow(_blocks(BLOCK), "block long, key long, text string"))
    wanted = dealt.select("block", "text").mapInArrow(_block_grams, "block long, gram long")
    parts = wanted.join(model.table.withColumnRenamed("key", "gram"), "gram").select("block", "gram", "own", "history")

    def run(texts: pa.Table, part: pa.Table) -> pa.Table:
        keys, first = np.unique(part["gram"].to_numpy(), return_index=True)
        own = Scorer(keys.astype(np.int64), *(part[c].to_numpy().astype(np.float64)[first] for c in ("own", "history")))
        slices = texts.select(["key", "text"]).to_batches()
        return pa.Table.from_batches([_measure_rows(own, x.column(0), x.column(1)) for x in slices], _MEASURES)

    both = dealt.groupBy("block").cogroup(parts.groupBy("block"))
    return both.applyInArrow(run, "key long, mean double, stretch double")


def measured(rows: DataFrame, model: Model) -> DataFrame:
    """``key, mean, stretch`` of rows ``key, text``."""
    rows = rows.toDF("key", "text").select(F.col("key").cast("long"), "text")
    if model.table is not None:
        return _joined(rows, model)
    # plain arrays, which a task can read without this package
    shared = rows.sparkSession.sparkContext.broadcast(model.grams)
    return rows.mapInArrow(_sent(shared), "key long, mean double, stretch double")


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge; ``x`` has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, calibration_rows: int = 20_000) -> Model:
    """Count the models on labelled rows; calibrate on at most about ``calibration_rows`` of those kept apart."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    marks = cut(marks.where(crc_mod(F.col("doc_id"), 3) != 1))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    learn = cut(only(rows, marks.select("doc_id"), "doc_id").join(marks, "doc_id"))
    h = hash60(F.col("doc_id"), "toxic:")
    model = count(learn.where(h % 4 != 0))
    apart = learn.where(h % 4 == 0)
    n = apart.count()
    if n > calibration_rows:
        apart = apart.where(F.shiftright(h, 8) % n < calibration_rows)
    found = measured(apart.select("toxic", "text"), model).toPandas()
    y = found["key"].to_numpy(np.float64)
    x = np.column_stack([found["mean"], found["stretch"], np.ones(len(found))]) if len(found) else np.zeros((0, 3))
    if 0 < y.sum() < len(y):
        model.fit = calibrate(x, y)
    else:
        share = float(y.mean()) if len(y) else 0.0
        model.fit = (0.0, 0.0, 30.0 if share else -30.0)
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    model = fit(docs, labels)
    a, b, c = model.fit
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = measured(rows, model).withColumnRenamed("key", "doc_id")
    logit = F.lit(a) * F.col("mean") + F.lit(b) * F.col("stretch") + F.lit(c)
    p = 1 / (1 + F.exp(-logit))
    return found.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        p.alias("score"),
        F.when(p >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )

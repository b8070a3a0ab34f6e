"""Helpers shared by the operators: reading, scratch tables, hashing, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ordered import top_k
from docloom.session import LARGE_ROWS, cut, scratch_path, scratch_root  # noqa: F401

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
# Texts given to one Arrow batch of results at most, in bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(key: Column, seed: str = "") -> Column:
    """60 bits of the md5 of a key written as text (null: empty), the same on any engine."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def crc_mod(key: Column, parts: int) -> Column:
    """crc32 of a key written as text (null: empty), modulo ``parts``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def hashed_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` rows of each value of ``by`` with the smallest ``h`` (ties by ``doc_id``).

    Rows whose hash is far above the wanted share of their group go first, where they lie, so that
    a group sends about ``2 * most`` rows to be ranked, however large it is. ``by`` has few values: their
    counts, one row each, are sent to all tasks.
    """
    counts = F.broadcast(rows.groupBy(by).agg(F.count("*").alias("_n")))
    near = rows.join(counts, by).where(F.col("h") / float(1 << 60) * F.col("_n") < 2.0 * most + 20).drop("_n")
    return top_k(near, [by], [F.col("h"), F.col("doc_id")], most)


_forgets: dict[str, Callable[[], object]] = {}


def hold_only(name: str, forget: Callable[[], object]) -> None:
    """Called by a task before it fills its worker's memo: those of other operators are forgotten.

    Python workers outlive tasks, so without it a worker would in time hold the memo of every stage.
    """
    _forgets[name] = forget
    for other, clear in _forgets.items():
        if other != name:
            clear()


def give_back() -> None:
    """Called by a task when it is done: its worker waits for the next one without memory that is free.

    The allocators of Arrow and of the C library keep what was freed for later; waiting workers would
    hold the most that any of their tasks took, beside an executor that works without Python.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_rows(
    fn: Callable[[tuple], Iterable[tuple]], schema: pa.Schema, weigh: int | None = None, rows: int = 4096
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a row-to-rows function.

    Results leave in slices of at most ``rows`` rows, or ``BATCH_BYTES`` bytes of result column
    ``weigh``, so a task holds one slice and not a whole batch of long texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                for made in fn(row):
                    out.append(made)
                    if weigh is not None:
                        held += len(made[weigh] or b"")
                    if len(out) >= rows or held >= BATCH_BYTES:
                        yield as_batch(out, schema)
                        out, held = [], 0
        if out:
            yield as_batch(out, schema)

    return run


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def window_ids(ids: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers that are equal exactly where windows of ``size`` values are equal."""
    n = len(ids)
    if n < size:
        return np.empty(0, np.int64)
    out, width = ids.astype(np.int64), 1
    while width < size:
        step = min(width, size - width)
        high = int(out.max()) + 1
        pairs = out[: len(out) - step] * high + out[step:]
        out = np.unique(pairs, return_inverse=True)[1]
        width += step
    return out


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word's number, in order of first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))

"""A uniform shuffle of all rows into shards of exact sizes.

Every assignment of rows to shards with the wanted sizes, and every order inside a shard, is equally
likely. Rows are neither sorted as a whole nor dealt by independent draws (whose shard sizes vary):

1. every row gets its place in the partition it was read in, written once to the shared folder, so a
   repeated task sees the same places. Blocks of ``BLOCK`` rows of a partition are the senders;
2. the communication matrix (rows each block sends to each shard) is drawn at once from its exact
   distribution: hypergeometric draws with the block sizes and shard sizes as margins, first for
   groups of blocks, then inside every group in a task of its own;
3. a task permutes each block and cuts the permutation by the block's matrix row;
4. rows are exchanged by (shard, random key), ranges of which go to tasks, so a shard of any size is
   permuted by many tasks; the place in that order is the row's slot.

Shard sizes differ by one row at most, larger ones first. The result follows from the seed and from how
the input is partitioned. Lost tasks are repeated with the same draws. A task holds one block and one
Arrow batch, or at most ``BLOCK`` matrix rows of a group of blocks.

Defined cases: repeated rows, and rows whose columns are null or empty, are rows like any other; an
empty table gives an empty one; an input column named like an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import cut
from docloom.operators.ordered import sorted_ordinal

SHARDS = 24
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
# Groups of blocks in which the matrix is drawn; at 10^11 rows one has some 1,500 blocks.
GROUPS = 1024
# numpy draws from populations below this size.
NUMPY_POPULATION = 10**9


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most: int = NUMPY_POPULATION) -> int:
    """How many of ``n`` rows drawn without replacement are among the ``good``; for any population."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    if good + bad < most:
        return int(rng.hypergeometric(good, bad, n))
    # inversion over twelve standard deviations around the mode; the rest has less weight than a rounding error
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))) + 40
    low, high = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def draw_matrix(rng: np.random.Generator, senders: list[int], room: list[int]) -> Iterator[list[int]]:
    """Per sender the rows it sends to each shard, so that all rooms are filled exactly."""
    room = list(room)
    for rows in senders:
        free, left, sent = sum(room), rows, []
        for size in room:
            free -= size
            sent.append(hypergeometric(rng, size, free, left))
            left -= sent[-1]
        room = [size - n for size, n in zip(room, sent, strict=True)]
        yield sent


def _drawn(seed: int, level: int):
    """mapInArrow function: rows (stream, senders, their rows, room) to (sender, its matrix row)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, senders, room in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng([seed, level, stream])
                rows = list(draw_matrix(rng, [s["n"] for s in senders], room))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["sender"] for s in senders], pa.int64()),
                        pa.array([s["n"] for s in senders], pa.int64()),
                        pa.array(rows, pa.list_(pa.int64())),
                    ],
                    names=["sender", "n", "sent"],
                )

    return draw


def communication_matrix(blocks: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """``sender, n, sent`` from ``sender, n``: the rows that every block sends to each shard."""
    schema = "sender long, n long, sent array<long>"
    grouped = blocks.select(F.pmod(F.hash("sender"), F.lit(GROUPS)).cast("long").alias("g"), "sender", "n")
    of_groups = grouped.groupBy("g").agg(F.sum("n").alias("n"))
    whole = of_groups.agg(F.sort_array(F.collect_list(F.struct(F.col("g").alias("sender"), "n"))).alias("senders"))
    room = F.array(*[F.lit(size).cast("long") for size in sizes])
    upper = whole.select(F.lit(0).cast("long"), "senders", room).mapInArrow(_drawn(seed, 0), schema)
    members = grouped.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("sender", "n"))).alias("senders"))
    lower = members.join(upper.select(F.col("sender").alias("g"), F.col("sent").alias("room")), "g")
    return lower.select("g", "senders", "room").mapInArrow(_drawn(seed, 1), schema)


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def deal(docs: DataFrame, shards: int = SHARDS, seed: int = 12, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with every row's ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (shard.lower(), slot.lower())])
    names = [*docs.columns, shard, slot]
    at = _fresh("_at", names)
    key = _fresh("_key", [*names, at])
    sent = _fresh("_sent", [*names, at, key])
    marked = cut(docs.select("*", F.monotonically_increasing_id().alias(at)))
    sender = F.shiftright(at, BLOCK_BITS)
    blocks = cut(marked.groupBy(sender.alias("sender")).agg(F.count("*").alias("n")))
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    matrix = cut(communication_matrix(blocks, shard_sizes(total, shards), seed))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = own = uppers = None
        for batch in batches:
            places = batch.column(width).to_numpy()
            block = places >> BLOCK_BITS
            to, keys = np.empty(len(places), np.int32), np.empty(len(places), np.int64)
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for low, high in zip(cuts, cuts[1:], strict=False):
                if block[low] != held:
                    held = int(block[low])
                    uppers = np.cumsum(batch.column(width + 1)[int(low)].as_py())
                    rng = np.random.default_rng([seed, 2, held])
                    own = rng.permutation(uppers[-1]), rng.integers(0, (1 << 63) - 1, uppers[-1])
                inside = places[low:high] & (BLOCK - 1)
                to[low:high] = np.searchsorted(uppers, own[0][inside], "right")
                keys[low:high] = own[1][inside]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(to), pa.array(keys)], [*batch.schema.names[:-1], shard, key]
            )

    width = len(docs.columns)
    # a hot block cannot be: each has BLOCK rows at most
    rows = marked.withColumn(sent, sender).join(
        matrix.select(F.col("sender").alias(sent), F.col("sent").alias(f"{sent}_row")), sent
    )
    fields = [*docs.schema.fields, T.StructField(at, T.LongType())]
    added = [T.StructField(shard, T.IntegerType()), T.StructField(key, T.LongType())]
    placed = rows.select(*docs.columns, at, f"{sent}_row").mapInArrow(permute, T.StructType([*fields, *added]))
    seq = _fresh("_seq", [*names, at, key])
    ordered = sorted_ordinal(placed, [F.col(shard), F.col(key), F.col(at)], seq)
    # where a shard starts in the whole order follows from the exact sizes
    before = F.col(shard) * F.lit(total // shards) + F.least(F.col(shard), F.lit(total % shards))
    return ordered.select(*docs.columns, shard, (F.col(seq) - 1 - before).cast("long").alias(slot))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 12) -> None:
    """Whole documents in one folder per shard (``shard=k``), each row with its ``slot``; a shard may
    have several files, each of consecutive slots in ascending order."""
    deal(docs, shards, seed).write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame) -> DataFrame:
    """Size, checksum, shard and slot of every document; the law is that of equal row counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return deal(narrow).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})

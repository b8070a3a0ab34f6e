"""Token ids as fixed-width bit-packed blocks, with offsets for random access.

Every id takes the fewest bits that hold the vocabulary. A block holds whole documents (a longer
document has a block of its own), its ids packed back to back, and an index of where each of its
documents starts; so any document, or any id, is one block read and one vectorised unpacking away.
Blocks are rows of a Parquet table: written and committed by Spark, readable wherever it reads.

File layout (``BLOCK_SCHEMA``), ordered by ``part`` and ``block``: ``bits`` per id, ``n_ids``,
``docs`` (id, first id within the part, number of ids) and ``payload``, ids in little-endian bit
order. ``first_id`` counts from the start of the part; ``part_offsets`` gives where a part starts
in the whole stream.

Defined cases: a null or empty text has only the end id; rows with equal or null ids are kept as
separate documents (nulls first); an empty table gives an empty file. The content of an added token in a
text becomes that token's id, as in the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import LARGE_ROWS, as_batch, give_back, hold_only, scratch_path
from docloom.llm.words import slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
# A block is closed by the document that fills it.
BLOCK_IDS = 1 << 16
# Bytes of text encoded together; arrays of some fifteen times as much are held for them.
SLICE_BYTES = 2 << 20
# Pre-tokens remembered by one Python worker; beyond them it starts anew.
REMEMBERED = 1 << 19

BLOCK_SCHEMA = (
    "part int, block int, first_id long, n_ids long, bits int, "
    "docs array<struct<doc_id:long,first_id:long,n_ids:long>>, payload binary"
)
_DOC = pa.struct([("doc_id", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64())])
_BLOCKS = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("first_id", pa.int64()),
        ("n_ids", pa.int64()),
        ("bits", pa.int32()),
        ("docs", pa.list_(_DOC)),
        ("payload", pa.binary()),
    ]
)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` bits each, lowest bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from id ``first`` on, without reading what lies before them."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, f"<u{width}", n, first * width).astype("<u4")
    low, high = first * bits, (first + n) * bits
    raw = np.frombuffer(payload, np.uint8)[low // 8 : -(-high // 8)]
    flat = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of texts; the library's model encodes each different pre-token once and its ids are remembered.

    Byte-level pre-tokenisation starts a new token at a space that another character follows, so texts
    fall into space-separated pieces, and pieces into pre-tokens, whose ids do not depend on their
    neighbours. Texts with two spaces together, a space at an end or before other white space, or
    the content of an added token go to the library whole.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.found = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        # pieces that follow a space, and pre-tokens that do not, by number; the ids of all numbers in one row
        self.known: dict[str, int] = {}
        self.inner: dict[str, int] = {}
        self.ids = np.empty(0, "<u4")
        self.starts = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        low = len(self.starts) - 1
        self.ids = np.append(self.ids, ids)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        return range(low, low + len(sizes))

    def _learn(self, tokens: list[str], memo: dict[str, int], space: str) -> None:
        """Ask the model for the ids of pre-tokens not in ``memo``."""
        new = [t for t in dict.fromkeys(tokens) if t not in memo]
        model, letters = self.model.tokenize, self.letters
        joined = "\0".join([space + t for t in new])
        if joined.count("\0") == len(new) - 1:
            spelled = joined.encode().decode("latin-1").translate(letters).split(letters[0])
        else:  # a text may hold any character
            spelled = [(space + t).encode().decode("latin-1").translate(letters) for t in new]
        made = [[x.id for x in model(t)] for t in spelled]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        memo.update(zip(new, self._add(np.array([i for own in made for i in own], "<u4"), sizes), strict=False))

    def _cut_up(self, piece: str) -> list[str]:
        """The pre-tokens of a piece, which is not only letters, the first without the space before it."""
        head, last = piece[:-1], piece[-1]
        if last in ".,;:!?" and head.isalpha():
            return [head, last]
        head, feed, tail = piece.partition("\n")
        if feed and tail.isalpha() and head and not head[-1].isspace():
            return [*([head] if head.isalpha() else self._cut_up(head)), feed, tail]
        first, *rest = self.found(" " + piece)
        return [first[1:], *rest]

    def _numbers(self, pieces: np.ndarray) -> np.ndarray:
        """The numbers of different pieces that follow a space."""
        if len(self.known) + len(self.inner) > REMEMBERED:
            self._forget()
        known = self.known
        numbers = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(numbers < 0)
        new = pieces[unknown].tolist()
        plain, others = [], []
        for p in new:
            (plain if p.isalpha() else others).append(p)
        cut_up = [self._cut_up(p) for p in others]
        self._learn([*plain, *(t[0] for t in cut_up)], known, " ")
        self._learn([t for own in cut_up for t in own[1:]], self.inner, "")
        several = [k for k, own in enumerate(cut_up) if len(own) > 1]
        if several:
            count = np.array([len(cut_up[k]) for k in several])
            flat = [n for k in several for n in (known[cut_up[k][0]], *map(self.inner.__getitem__, cut_up[k][1:]))]
            ids, size = _taken(self.ids, self.starts, np.array(flat))
            known.update(zip([others[k] for k in several], self._add(ids, np.add.reduceat(size, np.cumsum(count) - count)), strict=True))
        numbers[unknown] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        return numbers

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        import pyarrow.compute as pc

        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if not len(column):
            return []
        column = column.fill_null("")
        parts = pc.split_pattern(column, " ")
        cuts, flat = parts.offsets.to_numpy(), parts.flatten()
        cuts = cuts - cuts[0]
        coded = flat.dictionary_encode()
        place = coded.indices.to_numpy()
        different = coded.dictionary
        first = cuts[:-1]
        # the first piece of a text follows no space and is encoded by itself
        heads = flat.take(pa.array(first)).to_pylist()
        blank = pc.or_(pc.utf8_is_space(pc.utf8_slice_codeunits(different, 0, 1)), pc.equal(pc.binary_length(different), 0))
        unlike = blank.to_numpy(zero_copy_only=False)[place]
        unlike[first] = [not head and n > 1 for head, n in zip(heads, np.diff(cuts).tolist(), strict=True)]
        whole = np.logical_or.reduceat(unlike, first)
        for content in self.added:
            whole |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        later = ~np.repeat(whole, np.diff(cuts))
        later[first] = False
        used = np.zeros(len(different), bool)
        used[place[later]] = True
        numbers = np.zeros(len(different), np.int64)
        numbers[used] = self._numbers(different.filter(pa.array(used)).to_numpy(zero_copy_only=False))
        texts = column.filter(pa.array(whole)).to_pylist()
        alone = self._whole([h for h, full in zip(heads, whole.tolist(), strict=True) if not full])
        entire = self._whole(texts)
        # every place's number; what was encoded by itself comes behind the remembered ids
        entry = numbers[place]
        entry[first[~whole]] = len(self.starts) - 1 + np.arange(len(alone))
        entry[first[whole]] = len(self.starts) - 1 + len(alone) + np.arange(len(entire))
        later[first] = True
        own = [*alone, *entire]
        pool = np.concatenate([self.ids, *own])
        starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(x) for x in own], dtype=np.int64))
        stream, n = _taken(pool, starts, entry[later])
        ends = np.concatenate([[0], np.cumsum(n)])
        bounds = ends[np.concatenate([[0], np.cumsum(later)])[cuts]].tolist()
        return [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _taken(pool: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``entries`` (entry k lies from ``starts[k]`` on) in a row, and how many each has."""
    size = (starts[1:] - starts[:-1])[entries]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[entries] - (ends - size), size)
    at += np.arange(total)
    return pool[at], size


_ENCODERS: dict[str, Encoder] = {}


def _forget() -> None:
    _ENCODERS.clear()


def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder; the vocabulary file lies where the tokenizer package is installed."""
    if vocabulary not in _ENCODERS:
        import os

        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[vocabulary] = Encoder(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
    return _ENCODERS[vocabulary]


def write_ids(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Encode every text of ``docs`` and write the blocks to ``path`` in ascending ``doc_id`` order.

    The texts are dealt by ranges of ids and sorted within each part; that is the only shuffle. A
    task holds a block and one slice of texts.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hold_only("tokens", _forget)
        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary)
        bits = bits_for(max(encode.size, end_id + 1))
        end = np.array([end_id], "<u4")
        held: list[np.ndarray] = []
        index: list[dict] = []
        n_block = at = n = 0

        def closed() -> pa.RecordBatch:
            return as_batch([(part, n_block, at, n, bits, index, pack(np.concatenate(held), bits))], _BLOCKS)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for low, high in slices(texts, SLICE_BYTES):
                ids = encode.encode(texts.slice(low, high - low))
                for key, own in zip(keys[low:high], ids, strict=True):
                    index.append({"doc_id": key, "first_id": at + n, "n_ids": len(own) + 1})
                    held += (own, end)
                    n += len(own) + 1
                    if n >= block_ids:
                        yield closed()
                        held, index, n_block, at, n = [], [], n_block + 1, at + n, 0
        if index:
            yield closed()
        held, index = [], []
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first()
    )
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.options(**LARGE_ROWS).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def part_offsets(blocks: DataFrame) -> DataFrame:
    """``part, offset``: ids of the whole stream before each part; one row per written part."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("offset"))


_READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, n, bits, docs, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = unpack(payload, bits, n)
            rows = []
            for doc in docs:
                own = ids[doc["first_id"] - first : doc["first_id"] - first + doc["n_ids"]]
                rows.append((part, doc["doc_id"], doc["first_id"], doc["n_ids"], zlib.crc32(own.tobytes())))
            yield as_batch(rows, _READ)
    give_back()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the written blocks."""
    blocks = read_blocks(spark, path)
    rows = blocks.select("part", "first_id", "n_ids", "bits", "docs", "payload").mapInArrow(
        _sums, "part int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    # one row per part: at most as many as the write had tasks
    return rows.join(part_offsets(blocks), "part").select(
        "doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def ids_at(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """``place, id`` of ``n`` ids from place ``start`` of the whole stream: only their blocks are unpacked."""
    blocks = read_blocks(spark, path)
    placed = blocks.join(part_offsets(blocks), "part").withColumn("at", F.col("first_id") + F.col("offset"))
    wanted = placed.where((F.col("at") < start + n) & (F.col("at") + F.col("n_ids") > start))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.int64()), ("id", pa.int64())])
        for batch in batches:
            for at, held, bits, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = max(start, at), min(start + n, at + held)
                ids = unpack(payload, bits, high - low, low - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array(ids.astype("i8"))], schema=schema)

    return wanted.select("at", "n_ids", "bits", "payload").mapInArrow(cut_out, "place long, id long")


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` to a new shared file and read it back per document."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary, end_id)
    return read_documents(docs.sparkSession, path)

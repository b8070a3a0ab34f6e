"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` normalised bytes may differ from a passage in ``errors = m * rate`` edits. Cut
into ``errors + 1`` pieces, one piece must occur unchanged, so all pieces are looked up at once (one
automaton), and only around their hits is the edit distance computed, with bit-parallel columns.

The items are a stated query set: they are sent in blocks of at most ``BLOCK_BYTES`` bytes, each
block against all documents, without a shuffle.

Normalisation: lower case; ASCII punctuation and white space become single spaces; distances count
UTF-8 bytes. Whole texts are searched.

Defined cases: null or empty texts match nothing; null or blank items are ignored; an item of fewer
than ``MIN_BYTES`` normalised bytes says too little inside other text and only matches a text that
equals it; repeated documents or items each give their rows; no items, or no documents, no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import by_rows, give_back, hold_only

RATE = 0.05
MIN_BYTES = 24
# Item bytes of one block; the automaton takes some 50 times as much in each Python worker.
BLOCK_BYTES = 2 << 20

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(_PLAIN).split())


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` nearly equal pieces with their places."""
    n = min(errors + 1, len(item))
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest(item: bytes, text: bytes, free_start: bool = True) -> tuple[int, int]:
    """Least edit distance of ``item`` to a part of ``text``, and where the first such part ends.

    With ``free_start`` false the part begins where the text begins.
    """
    m = len(item)
    full, last = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = {}
    for k, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << k
    up, down, score = full, 0, m
    best, end = m, 0
    carry = 0 if free_start else 1
    for k, c in enumerate(text):
        eq = equal.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | ~(across | up) & full
        minus = up & across
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = (plus << 1 | carry) & full
        minus = minus << 1 & full
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical
        if score < best:
            best, end = score, k + 1
    return best, end


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        import ahocorasick

        self.items = [(key, item, int(len(item) * rate)) for key, item in items]
        self.whole: dict[bytes, list[int]] = {}
        starts: dict[bytes, list[tuple[int, int]]] = {}
        for place, (_, item, errors) in enumerate(self.items):
            if len(item) < MIN_BYTES:
                self.whole.setdefault(item, []).append(place)
                continue
            for at, piece in pieces(item, errors):
                starts.setdefault(piece, []).append((place, at))
        self.automaton = ahocorasick.Automaton() if starts else None
        for piece, found in starts.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), found))
        if starts:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """``item, distance, start, end`` (in normalised bytes) of every item found, once each."""
        data = normalised(text)
        for place in self.whole.get(data, ()) if data else ():
            yield self.items[place][0], 0, 0, len(data)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, found) in self.automaton.iter(data.decode("latin-1")) if self.automaton else ():
            for place, at in found:
                _, item, errors = self.items[place]
                low = max(0, last + 1 - size - at - errors)
                high = last + 1 - size - at + len(item) + errors
                own = windows.setdefault(place, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        for place, own in windows.items():
            key, item, errors = self.items[place]
            best = None
            for low, high in sorted(own):
                distance, end = nearest(item, data[low:high])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, low, low + end)
                    if not distance:
                        break
            if best:
                distance, low, end = best
                back = nearest(item[::-1], data[low:end][::-1], free_start=False)[1]
                yield key, distance, end - back, end


_MATCHERS: dict[str, Matcher] = {}


def _matcher(block, rate: float) -> Matcher:
    """This worker's automaton of a broadcast block; the last one is kept."""
    hold_only("decontaminate", _MATCHERS.clear)
    name, items = block.value
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(items, rate)
    return _MATCHERS[name]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcast lists of (item, normalised bytes), each of about ``block_bytes`` bytes."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    found = []
    for k in range(n):
        block = [(row[0], normalised(row[1])) for row in items.where(key == k).collect()]
        block = sorted(((key_, item) for key_, item in block if item), key=lambda x: (x[0] is None, x))
        if block:
            found.append(items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)))
    return found


_HITS = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in ("item_id", "distance", "start", "end"))])


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, distance, start, end``: a row per document and item it contains."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance long, start long, end long"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, block_bytes):
        search = by_rows(lambda row, b=block: [(row[0], *hit) for hit in _matcher(b, rate).find(row[1])], _HITS)
        found = found.unionByName(docs.mapInArrow(search, schema))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns; no shuffle and no join."""
    place = [name.lower() for name in docs.columns].index("text")
    for block in _blocks(benchmark, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matcher = _matcher(block, rate)
                clean = [next(matcher.find(t.as_py()), None) is None for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))
            give_back()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

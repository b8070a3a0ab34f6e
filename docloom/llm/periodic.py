"""Periodic runs of words: stretches that repeat one phrase back to back.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal), at least
``LEAST_WORDS`` words and ``TIMES`` periods long, that no neighbouring word extends. ``find_runs``
lists the runs of every text, ``collapse`` keeps the first period of each.

Inside a task, over slices of whole texts held as arrays of word numbers:

* periods up to ``SHORT`` come from direct scans: a text is compared with itself ``q`` words later;
* longer periods come from minimizers at scales W = SHORT, 2 SHORT, 4 SHORT, ...: in a run of period
  q, W < q <= 2W, the smallest hash of a window of W places recurs q places later, and a stretch of
  2W >= q words recurs at no smaller distance. So neighbouring minimizers of equal stretches give
  every such run's period. Each pair is a seed, extended both ways as far as words stay equal.

A stretch's key has 64 bits; extents are compared word by word before a run is reported. Work and
memory are in proportion to the words of a slice (times the number of scales). Nothing is shuffled.

Defined cases: a null or empty text has no runs and collapses to an empty text; rows with equal or
null ids are kept as they are; ties cannot occur, since a stretch has one smallest period; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import slices, split

LEAST_WORDS = 6
TIMES = 4
# Longest period that is scanned for directly.
SHORT = 16
# Words whose hash orders the places of a window.
ORDER_GRAM = 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())]
)
FOUND_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Stretches:
    """Hashes of any stretch of ``ids`` in constant time."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        steps = np.full(n + 1, _BASE)
        steps[0] = 1
        back = np.full(n + 1, _INVERSE)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(steps)[:n], out=self.sums[1:])

    def at(self, places: np.ndarray, length) -> np.ndarray:
        return (self.sums[places + length] - self.sums[places]) * self.back[places]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.at(a, length) == self.at(b, length)


def _longest(fits, most: np.ndarray) -> np.ndarray:
    """Per seed the greatest length up to ``most`` that ``fits``; every smaller one fits as well."""
    low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = fits(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _by_lag(ids: np.ndarray, q: int) -> list[np.ndarray]:
    """Start, length and period of all stretches that are long enough for period ``q``."""
    equal = np.flatnonzero(ids[q:] == ids[:-q])
    need = max(LEAST_WORDS, TIMES * q) - q
    if len(equal) < need:
        return []
    cuts = np.flatnonzero(np.diff(equal) != 1) + 1
    low = np.concatenate([[0], cuts])
    length = np.diff(np.append(low, len(equal)))
    long = length >= need
    return [np.stack([equal[low[long]], length[long] + q, np.full(long.sum(), q)])]


def _by_minimizers(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The same for all periods above ``SHORT``; texts stand in descending order of ``sizes``."""
    n = len(ids)
    if n <= TIMES * SHORT:
        return []
    hashes = _Stretches(ids)
    places = np.arange(n - ORDER_GRAM + 1)
    order = _mixed(hashes.at(places, ORDER_GRAM)) >> np.uint64(32) << np.uint64(32) | places.astype(np.uint64)
    ends = np.cumsum(sizes + 1)
    found, width, scale = [], 1, SHORT
    while True:
        # only texts that can hold a run of this scale: the first ones
        able = int(np.searchsorted(-sizes, -(TIMES * (scale + 1)), "right"))
        if not able:
            return found
        order = order[: ends[able - 1]]
        while width < scale:
            order = np.minimum(order[:-width], order[width:])
            width *= 2
        chosen = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        chosen = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
        chosen = chosen[chosen + 2 * scale <= ends[able - 1]]
        keys = hashes.at(chosen, 2 * scale)
        by = np.argsort(keys, kind="stable")
        first, later = chosen[by[:-1]], chosen[by[1:]]
        far = later - first
        seed = (keys[by[1:]] == keys[by[:-1]]) & (far > scale) & (far <= 2 * scale)
        if seed.any():
            found.append(_extended(ids, hashes, first[seed], far[seed]))
        scale *= 2


def _extended(ids: np.ndarray, hashes: _Stretches, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole stretches of period ``q`` around the seeds, those of at least ``TIMES`` periods."""
    ahead = _longest(lambda k: hashes.same(at, at + q, k), len(ids) - at - q)
    back = _longest(lambda k: hashes.same(at - k, at + q - k, k), at)
    made = np.unique(np.stack([at - back, back + q + ahead, q]), axis=1)
    made = made[:, made[1] >= TIMES * made[2]]
    good = [bool((ids[s : s + n - p] == ids[s + p : s + n]).all()) for s, n, p in made.T.tolist()]
    for k in np.flatnonzero(~np.array(good, bool)).tolist():
        # equal hashes of different stretches: walk along the words instead
        s, n, p = made[:, k].tolist()
        equal = np.flatnonzero(ids[p:] != ids[:-p])
        middle = s + n // 2
        cut = int(np.searchsorted(equal, middle))
        low = int(equal[cut - 1]) + 1 if cut else 0
        high = int(equal[cut]) if cut < len(equal) else len(ids) - p
        made[:, k] = low, high - low + p, p
    return made[:, made[1] >= TIMES * made[2]]


def runs_of(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and (start, length, period) columns of all runs, by text, start and period.

    ``ids`` are word numbers from 0 on; text ``d`` holds those from ``first[d]`` to ``first[d + 1]``.
    """
    sizes = np.diff(first)
    texts = np.flatnonzero(sizes >= LEAST_WORDS)
    texts = texts[np.argsort(-sizes[texts], kind="stable")]
    sizes = sizes[texts]
    if not len(texts):
        return np.empty(0, np.int64), np.empty((3, 0), np.int64)
    # one array with a word of its own behind every text, so that nothing equal crosses a border
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    joined = np.empty(ends[-1], np.int64)
    held = np.ones(ends[-1], bool)
    held[ends - 1] = False
    joined[held] = ids[np.repeat(first[texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    joined[ends - 1] = int(ids.max()) + 1 + np.arange(len(texts))
    found = [x for q in range(1, min(SHORT, int(sizes[0]) // TIMES) + 1) for x in _by_lag(joined, q)]
    found += _by_minimizers(joined, sizes)
    if not found:
        return np.empty(0, np.int64), np.empty((3, 0), np.int64)
    runs = np.concatenate(found, axis=1)
    # a stretch found by several periods has the smallest of them, which divides the others
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)
    runs = runs[:, new]
    text = np.searchsorted(ends, runs[0], "right")
    runs[0] -= starts[text]
    text = texts[text]
    by = np.lexsort((runs[2], runs[0], text))
    return text[by], runs[:, by]


def _scanned(keys: pa.Array, column: pa.Array) -> pa.RecordBatch:
    parts = split(column)
    coded = parts.words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, runs = runs_of(ids, parts.first)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, parts.first[text] + runs[0] + runs[2], 1)
    np.add.at(edge, parts.first[text] + runs[0] + runs[1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    sums = np.concatenate([[0], np.cumsum(kept)])
    words = parts.words if kept.all() else parts.words.filter(pa.array(kept))
    lists = pa.ListArray.from_arrays(pa.array(sums[parts.first].astype(np.int32)), words)
    counts = np.bincount(text, minlength=len(column))
    spans = pa.StructArray.from_arrays([pa.array(x) for x in runs], fields=list(_RUN))
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(np.diff(parts.first)),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans),
            pc.binary_join(lists, b" ").cast(pa.string()),
        ],
        schema=_FOUND,
    )


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs by start and period, and the text
    without what a run repeats, words joined by single spaces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            texts = texts.fill_null("")
            for low, high in slices(texts):
                yield _scanned(keys.slice(low, high - low), texts.slice(low, high - low))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, FOUND_SCHEMA)


def collapse(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every text without the words that its runs repeat."""
    return find_runs(docs).select("doc_id", F.col("collapsed").alias("text"))


def greatest(runs: str) -> Column:
    """The run of greatest length / period of a column of runs; the first of equal ones; null without runs."""
    none = "CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>)"
    return F.expr(
        f"aggregate({runs}, {none}, (best, r) -> "
        "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which one text of ten turns periodic: with h = crc32(doc_id), g = h / 10 and
    h % 10 = 0, word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8).

    A row without an id keeps its text.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    spread = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("h", F.crc32(F.col("doc_id").cast("string")))
        .withColumn("w", F.when(F.col("h") % 10 == 0, words))
        .withColumn("n", F.size("w"))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    )
    turned = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[CAST(a + (i - a) % p AS INT)] END), ' ')")
    return spread.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: number of runs, the greatest one, and digests of all runs and of the text."""
    lines = F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))")
    best = F.col("best")
    return found.withColumn("best", greatest("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::UBIGINT,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
               lambda x, z: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents),
a AS (
  SELECT *, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
o AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM o x JOIN o y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, g),
r AS (
  SELECT doc_id, start, length, min(q) AS period FROM l WHERE length >= greatest(6, 4 * q)
  GROUP BY doc_id, start, length),
b AS (
  SELECT doc_id, first({'s': start, 'l': length, 'p': period} ORDER BY length::DOUBLE / period DESC, start, period) AS best,
         count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
  FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM o ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.best.s AS start, b.best.l::BIGINT AS length, b.best.p AS period,
       1000 * b.best.l::BIGINT // b.best.p AS exponent_milli,
       sha256(coalesce(b.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set holds the distinct shingles of ``SHINGLE`` words. Two documents link when
100 * |A and B| >= ``percent`` * |A or B|. Documents with equal sets form a class and are
represented by one of them. In a global order of shingles, frequent ones last, linked sets share
one of their first ``n - ceil(percent * n / 100) + 1`` shingles, so only those are joined on.

Linking needs no list of all pairs, which a large group of near copies would square:

1. within each shared prefix shingle, every document is paired with the one before it and with the
   first one (sorted by size), filtered by length, position and suffix, and verified;
2. what links is labelled with connected components;
3. shingles whose documents lie in several components are looked at again: neighbours of different
   components in a random order are compared and their components joined, a few times over;
4. what is then still apart is joined across components, all pairs of them, with the same filters.

A pair that links shares a prefix shingle, so it is either within one component before step 4 or
compared in it: no link is lost.

Shingles are 64-bit hashes of their words; class keys are 128-bit. The order of shingles takes the
``HEAVY`` most repeated ones (a bounded broadcast) as frequent; it changes the work, never the result.

Defined cases: text without words, or null: empty set, links with nothing, its own component; fewer
words than a shingle: the whole sequence is the one shingle; rows with equal ids are one node; a row
with a null id links with nothing and has component null; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import cut, give_back, hold_only
from docloom.llm.members import components, only, without
from docloom.llm.words import slices, split

SHINGLE = 4
PERCENT = 85
# Shingles treated as frequent, at most; each task proposes at most HEAVY_TASK.
HEAVY = 1 << 16
HEAVY_TASK = 1 << 12
# Classes of the suffix filter.
CLASSES = 128
# Words and classes a Python worker remembers.
REMEMBERED = 1 << 18
# What a task holds at a time besides its Arrow batch: bytes of text cut into shingles, rows given or compared.
TEXT_BYTES = 1 << 20
ROWS = 1 << 10
# Rounds after the first: all but the last compare neighbours, the last one whatever is still apart.
STEPS = 4
NEIGHBOURS = 6
# One frequent shingle's documents are ordered in parts of about this many.
PART_ROWS = 1 << 13

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_words: dict[bytes, int] = {}
_hashes = array("Q")


def _forget() -> None:
    _words.clear()
    del _hashes[:]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (A-Z lower-cased), as unsigned 64-bit."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    if len(_words) > REMEMBERED:
        _forget()
    known = _words.get
    numbers = [known(word, -1) for word in words]
    if -1 in numbers:
        for k, number in enumerate(numbers):
            if number < 0:
                word = words[k]
                at = _words.setdefault(word, len(_words))
                if at == len(_hashes):
                    _hashes.append(xxhash.xxh3_64_intdigest(word))
                numbers[k] = at
    h = np.frombuffer(_hashes, np.uint64)[numbers]
    n = len(h) - size + 1
    total = h[:n] * _FACTORS[0]
    for k in range(1, size):
        total += (h[k : k + n] ^ np.uint64(k)) * _FACTORS[k % 4]
    return np.unique(_mixed(total))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """``shingles`` of every text of a column, from arrays of words of many texts."""
    column = column.fill_null("")
    for low, high in slices(column, TEXT_BYTES):
        parts = split(column.slice(low, high - low), lower=True)
        coded = parts.words.dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        h = own[coded.indices.to_numpy(zero_copy_only=False)]
        n = max(0, len(h) - size + 1)
        total = h[:n] * _FACTORS[0]
        for k in range(1, size):
            total += (h[k : k + n] ^ np.uint64(k)) * _FACTORS[k % 4]
        total = _mixed(total)
        for a, b in zip(parts.first.tolist(), parts.first[1:].tolist(), strict=False):
            if b - a >= size:
                yield np.unique(total[a : b - size + 1])
            else:
                few = parts.words.slice(a, b - a).to_pylist()
                yield np.array([xxhash.xxh3_64_intdigest(b" ".join(few), 1)] if few else [], np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


class _Frequent:
    """The shingles most repeated within one task."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n = 0
        self.counts: dict[int, int] = {}

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.n += len(h)
        if self.n > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        values, count = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.n = [], 0
        keep = np.flatnonzero(count > 1)
        if len(keep) > HEAVY_TASK:
            keep = keep[np.argpartition(count[keep], -HEAVY_TASK)[-HEAVY_TASK:]]
        for v, c in zip(_signed(values[keep]).tolist(), count[keep].tolist(), strict=True):
            self.counts[v] = self.counts.get(v, 0) + c
        if len(self.counts) > 4 * HEAVY_TASK:
            self.counts = dict(sorted(self.counts.items(), key=lambda x: -x[1])[:HEAVY_TASK])


_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sig", pa.list_(pa.int8())), ("heavy", pa.bool_()), ("least", pa.binary())]
)
_SETS_SQL = "doc_id long, n long, c1 long, c2 long, sig array<tinyint>, heavy boolean, least binary"


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of ``n``, of which linked sets share one."""
    return n - (percent * n + 99) // 100 + 1


def _set_rows(size: int, percent: int):
    """Sets with their smallest hashes, once per class and task: twice what a prefix needs, since frequent
    shingles, not known yet, do not belong in it."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SETS, strict=True)], schema=_SETS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only("jaccard", _forget)
        frequent, seen, given = _Frequent(), set(), set()
        for batch in batches:
            rows = []
            for key, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                digest = xxhash.xxh3_128_intdigest(h.tobytes())
                sig = np.bincount((h & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                sig = np.minimum(sig, 127).tolist()
                c1, c2 = ((digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63))
                least = None
                if key is not None and len(h) and digest not in given:
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(digest)
                    least = h[: 2 * prefix_length(len(h), percent) + 16].tobytes()
                rows.append((key, len(h), c1, c2, sig, False, least))
                if digest not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    frequent.add(h)
                if len(rows) == ROWS:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)
        frequent.settle()
        top = sorted(frequent.counts.items(), key=lambda x: -x[1])[:HEAVY_TASK]
        if top:
            yield made([(k, n, 0, 0, None, True, None) for k, n in top])
        give_back()

    return run


_PREFIX = pa.schema([("shingle", pa.int64()), ("parts", pa.int32()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_PREFIX_SQL = "shingle long, parts int, doc long, n int, pos int"


def _counts(h: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each shingle was met, 0 if it is not one of the frequent ones."""
    if not len(values):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
    return np.where(values[at] == h, counts[at], 0)


def _too_few(h: np.ndarray, count: np.ndarray, n: int, percent: int) -> bool:
    """Whether the least hashes ``h`` of a set of ``n`` hold too many frequent shingles to fill its prefix."""
    return len(h) < n and np.count_nonzero(count == 0) < prefix_length(n, percent)


def _short_rows(heavy, percent: int):
    """Ids of the stored sets (doc, n, least) whose least hashes are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = heavy.value
        for batch in batches:
            keys, sizes, least = (c.to_pylist() for c in batch.columns)
            sets = ((np.frombuffer(x, np.uint64), n) for x, n in zip(least, sizes, strict=True))
            short = [_too_few(h, _counts(h, values, counts), n, percent) for h, n in sets]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, s in zip(keys, short, strict=True) if s], pa.int64())], ["doc_id"])
        give_back()

    return run


def _prefix_rows(heavy, size: int, percent: int, stored: bool):
    """Prefix shingles of every set: (doc, n, least) if ``stored``, else (doc, text).

    A stored set whose least hashes hold too many frequent shingles gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only("jaccard", _forget)
        values, counts = heavy.value
        held: list[tuple] = []
        n_held = 0

        def made() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PREFIX, strict=True)], schema=_PREFIX)

        for batch in batches:
            if stored:
                keys, sizes, least = (c.to_pylist() for c in batch.columns)
                given = zip(keys, sizes, (np.frombuffer(x, np.uint64) for x in least), strict=True)
            else:
                given = ((key, len(h), h) for key, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True))
            for key, n, h in given:
                if not n:
                    continue
                length = prefix_length(n, percent)
                count = _counts(h, values, counts)
                if _too_few(h, count, n, percent):
                    continue
                first = np.lexsort((h, count))[:length] if count.any() else np.arange(length)
                held.append(
                    (
                        _signed(h[first]),
                        (count[first] // PART_ROWS + 1).astype(np.int32),
                        np.full(length, key, np.int64),
                        np.full(length, n, np.int32),
                        np.arange(length, dtype=np.int32),
                    )
                )
                n_held += length
                if n_held > 1 << 16:
                    yield made()
                    held, n_held = [], 0
        if held:
            yield made()
        give_back()

    return run


def _fits(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length filter, and positional filter for a pair's first common shingle."""
    length = (100 * F.least(na, nb)) >= (percent * F.greatest(na, nb))
    most = F.least(na - pa_, nb - pb)
    return length & ((100 + percent) * most >= percent * (na + nb))


def _grouped(prefix: DataFrame, percent: int) -> DataFrame:
    """Prefix rows with the row before (``prev``) and the first one (``head``) of their shingle, by size.

    Of a shingle in one part, only rows stay that may pass ``_fits`` with another one: most shingles that
    documents share by chance, ever more as documents grow in number, belong to documents of other sizes.
    """

    def packed(high: Column, low: Column) -> Column:
        return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))

    # rows are moved as four numbers, before what the window needs is made of them
    # one part of a shingle holds about PART_ROWS rows, however frequent the shingle is
    share, spot = packed(F.col("parts"), _part("doc", 0)), packed(F.col("n"), F.col("pos"))
    moved = prefix.select(share.alias("share"), "shingle", "doc", spot.alias("spot")).repartition("shingle", "share")
    prefix = moved.select(
        "share", "shingle", F.shiftright("share", 32).cast("int").alias("parts"), "doc",
        F.shiftright("spot", 32).cast("int").alias("n"), F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"),
    )
    order = W.partitionBy("shingle", "share").orderBy("n", "doc")
    at = F.struct("doc", "n", "pos")

    # a and b pass if percent * n_b <= reach(a) and percent * n_a <= reach(b)
    def reach(n: Column, pos: Column) -> Column:
        return 100 * n.cast("long") - (100 + percent) * pos.cast("long")

    own, size = reach(F.col("n"), F.col("pos")), percent * F.col("n").cast("long")
    groups = prefix.select(
        "*",
        F.lag(at).over(order).alias("prev"),
        F.first(at).over(order).alias("head"),
        F.lead(F.struct("n", "pos"), 1).over(order).alias("x"),
        F.lead("n", 2).over(order).alias("y"),
        F.max(own).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("most"),
    )
    before = (F.col("most") >= size) & (percent * F.col("head.n").cast("long") <= own)
    after = (percent * F.col("x.n").cast("long") <= own) & (size <= reach(F.col("x.n"), F.col("x.pos")))
    later = percent * F.col("y").cast("long") <= own
    fits = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)) | F.coalesce(later, F.lit(False))
    return groups.where((F.col("parts") > 1) | fits).drop("share", "x", "y", "most")


def _suffix_fits(na: Column, sa: Column, nb: Column, sb: Column, percent: int) -> Column:
    """Sets that differ too much in the sizes of hash classes cannot overlap enough."""
    apart = F.aggregate(
        F.zip_with(sa, sb, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x
    )
    return (100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb)


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose texts link; only the texts of documents in a pair are moved."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = only(docs, ids, "doc_id")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only("jaccard", _forget)
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for low in range(0, len(batch), ROWS):
                some = batch.slice(low, ROWS)
                for ta, tb in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    if last[0] != tb:
                        last = (tb, shingles(tb, size))
                    keep.append(similar(shingles(ta, size), last[1], percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _forget()
        give_back()

    return cut(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct())


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(docs.mapInArrow(_set_rows(size, percent), _SETS_SQL))
    sets = rows.where("not heavy")
    top = (
        rows.where("heavy")
        .groupBy(F.col("doc_id").alias("shingle"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "shingle")
        .limit(HEAVY)
        .toPandas()
    )
    values = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    heavy = spark.sparkContext.broadcast((values[order], top["n"].to_numpy(np.int64)[order]))

    members = sets.where("n > 0 and doc_id is not null")
    classes = cut(members.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")))
    nodes = cut(members.join(classes, ["c1", "c2"]).select("doc_id", "rep", "n", "sig").dropDuplicates(["doc_id", "rep"]))
    # rows that share an id are one node, whatever their texts
    first = nodes.groupBy("doc_id").agg(F.min("rep").alias("m"), F.max("rep").alias("x")).where("m <> x")
    same = nodes.join(first, "doc_id").where("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b"))

    least = sets.where("least is not null").select("doc_id", "n", "least")
    # sets with many frequent shingles are read from their texts again; rows that share an id all are
    short = cut(least.mapInArrow(_short_rows(heavy, percent), "doc_id long").distinct())
    again = only(docs, short, "doc_id").select("doc_id", "text")
    again = again.mapInArrow(_prefix_rows(heavy, size, percent, False), _PREFIX_SQL)
    prefix = least.mapInArrow(_prefix_rows(heavy, size, percent, True), _PREFIX_SQL).union(again)
    groups = cut(_grouped(prefix, percent))
    at = F.struct("doc", "n", "pos")
    # the first rows of the parts are paired along the shingle
    heads = groups.where("prev is null and parts > 1")
    across = W.partitionBy("shingle").orderBy("n", "doc")
    heads = heads.select("doc", "n", "pos", F.lag(at).over(across).alias("o"))
    near = groups.select("doc", "n", "pos", F.explode(F.array("prev", "head")).alias("o")).union(heads)
    near = near.where(F.col("o").isNotNull() & (F.col("o.doc") != F.col("doc")))
    near = near.where(_fits(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent))
    near = near.select(F.least("doc", "o.doc").alias("a"), F.greatest("doc", "o.doc").alias("b")).distinct()

    def named(side: str) -> DataFrame:
        return nodes.select(
            F.col("doc_id").alias(side), F.col("rep").alias(f"r{side}"), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}")
        )

    def candidates(pairs: DataFrame) -> DataFrame:
        found = pairs.join(named("a"), "a").join(named("b"), "b").where("ra <> rb")
        found = found.where(_suffix_fits(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), percent))
        return found.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    tried = cut(candidates(near))
    label = components(_verified(docs, tried, size, percent).union(same))
    reps = nodes.select("rep").distinct()
    place = cut(
        reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp"))
    )
    # from here on ids are representatives: copies of a class in several tasks fall together
    spots = groups.select("shingle", "parts", "doc", "n", "pos").join(
        nodes.select(F.col("doc_id").alias("doc"), "rep"), "doc"
    )
    spots = spots.drop("doc").distinct()
    for step in range(1, STEPS + 1):
        rows = spots.join(place, "rep")
        split = rows.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        spots = cut(rows.join(split.select("shingle"), "shingle"))
        found = _across(spots, percent) if step == STEPS else _neighbours(spots, step, percent)
        pairs = cut(candidates(found).join(tried, ["a", "b"], "left_anti"))
        place = _joined(place, _verified(docs, pairs, size, percent))
        tried = tried.union(pairs)
        spots = spots.drop("comp")
    best = nodes.join(place, "rep").groupBy("doc_id").agg(F.min("comp").alias("component_id"))
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(best, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _part(key: str, step: int) -> Column:
    """The part of a frequent shingle that a document falls into, another one in each step."""
    return F.pmod(F.xxhash64(key, F.lit(step)), F.col("parts"))


def _neighbours(spots: DataFrame, step: int, percent: int) -> DataFrame:
    """Pairs of different components that are neighbours in a random order of each shingle's documents."""
    order = W.partitionBy("shingle", _part("rep", step)).orderBy(F.xxhash64("rep", F.lit(-step)), "rep")
    before = F.array(*(F.lag(F.struct("rep", "n", "pos", "comp"), k).over(order) for k in range(1, NEIGHBOURS + 1)))
    near = spots.select("rep", "n", "pos", "comp", before.alias("before"))
    near = near.withColumn("o", F.explode("before")).where(F.col("comp") != F.col("o.comp"))
    near = near.where(_fits(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent))
    return near.select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).distinct()


def _across(spots: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a prefix shingle and pass its filters."""
    # the filters of any two members, on what is known of their components
    sides = spots.groupBy("shingle", "comp").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("left")
    )
    x, y = (sides.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in sides.columns[1:])) for side in "xy")
    length = (100 * F.col("high_x") >= percent * F.col("low_y")) & (100 * F.col("high_y") >= percent * F.col("low_x"))
    reach = (100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("low_x") + F.col("low_y"))
    cross = x.join(y, "shingle").where((F.col("comp_x") < F.col("comp_y")) & length & reach)
    cross = cross.select("shingle", F.col("comp_x").alias("ca"), F.col("comp_y").alias("cb"))
    a = spots.select("shingle", F.col("comp").alias("ca"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = spots.select("shingle", F.col("comp").alias("cb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    fits = _fits(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)
    found = cross.join(a, ["shingle", "ca"]).join(b, ["shingle", "cb"]).where(fits)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(place: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, comp`` after more links: components of components."""
    ends = links.join(place.select(F.col("rep").alias("a"), F.col("comp").alias("x")), "a").join(
        place.select(F.col("rep").alias("b"), F.col("comp").alias("y")), "b"
    )
    moved = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = moved.select(F.col("node").alias("comp"), F.col("component").alias("low"))
    return cut(place.join(moved, "comp", "left").select("rep", F.coalesce("low", "comp").alias("comp")))


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that are not the first of their component.

    Rows with equal ids are one document and stay together.
    """
    linked = link(docs, size, percent)
    dropped = cut(linked.where("component_id <> doc_id").select("doc_id").distinct())
    return without(docs, dropped, "doc_id").select(*(F.col(f"`{c}`") for c in docs.columns))

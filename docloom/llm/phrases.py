"""Collocations: phrases whose words occur together far more often than their parts would by chance.

Everything is per language. A phrase of up to ``longest`` words is counted wherever its words follow each
other inside a piece (a stretch without ``STOPS``). Counting goes by phrase length:

1. words are counted in Spark; texts are written once as word numbers (rare words and ends of pieces are 0);
2. the frequent phrases of one length are a trie that every task gets; numpy moves the states of all
   places of a block of texts through it together, a level at a time;
3. two frequent phrases at neighbouring places overlap in all but one word and so make a phrase one word
   longer. A task sums its pairs and gives all of them as arrays, dealt by a hash of the pair; Spark
   brings each share of the pairs together, where their counts are added. A phrase is frequent only if
   both its parts are (Apriori), so these are its exact counts and the next trie.

At most one pair leaves a task for every word that it reads: none is held back until it was met more
often, so what is passed on follows the input whatever the number of tasks.

The trie and the word numbers are sent to tasks while they have at most ``MOST_WORDS`` words and
``MOST_PHRASES`` phrases (some 150 MB together). Beyond that ``count_shuffled`` counts all phrases by
one grouping, with the same rows. The scores are exact whole numbers in 38 digits.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count each
time; an empty table gives an empty one; other columns are ignored; equal scores go by count, then by
the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LARGE_ROWS, cut, give_back
from docloom.llm.tries import Trie, build, step
from docloom.llm.words import slices, split
from docloom.operators.ordered import top_k

SPACES = b" \t"
STOPS = b".,;:!?\n\x0b\x0c\r"
LEAST = 100
LONGEST = 5
TOP = 2000
MOST_WORDS = 1 << 20
MOST_PHRASES = 1 << 21
# Bytes of text taken together; what a task holds besides its Arrow batch follows it.
BLOCK_BYTES = 2 << 20
# Overlapping pairs that a task holds before it passes on what it has.
HELD_PAIRS = 1 << 20
# Pairs are summed in shares that get about so many words' pairs each.
SHARE_WORDS = 1 << 21

_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_CODED = pa.schema([("lang", pa.string()), ("m", pa.int64()), ("ids", pa.binary())])
# codes of what was met and how often (longs), of one share
_MET = pa.schema([("share", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
_MET_SQL = "share int, codes binary, counts binary"
_OFTEN = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per slice of a batch: languages, each word's language and piece, word places and different words."""
    for low, high in slices(batch.column(1), BLOCK_BYTES):
        langs = batch.column(0).slice(low, high - low).dictionary_encode()
        parts = split(batch.column(1).slice(low, high - low), SPACES, STOPS, lower=True)
        coded = parts.words.dictionary_encode()
        own = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(parts.first)).astype(np.int64)
        places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield langs.dictionary, own, parts.piece, places, coded.dictionary


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, own, _, places, words in _by_language(batch):
                codes, n = np.unique(own * len(words) + places, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(codes // max(1, len(words)))),
                     words.take(pa.array(codes % max(1, len(words)))).cast(pa.string()), pa.array(n)],
                    schema=_COUNTED,
                )
        give_back()

    rows = _rows(docs).mapInArrow(count, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, words: list[str]) -> DataFrame:
    """``lang, m, ids``: blocks of texts as word numbers from 1; 0 is the end of a piece, or another word.

    ``m`` is the number of numbers above 0.
    """
    known = docs.sparkSession.sparkContext.broadcast([w.encode() for w in words])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(known.value, pa.binary())
        for batch in batches:
            for langs, own, piece, places, found in _by_language(batch):
                symbols = pc.index_in(found, wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
                for k, lang in enumerate(langs.to_pylist()):
                    mine = np.flatnonzero(own == k)
                    if not len(mine):
                        continue
                    ends = np.cumsum(np.diff(piece[mine], prepend=piece[mine[0]]) != 0)
                    ids = np.zeros(len(mine) + int(ends[-1]), np.int32)
                    ids[np.arange(len(mine)) + ends] = symbols[places[mine]]
                    ids = ids[(ids > 0) | (np.concatenate([[0], ids[:-1]]) > 0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([np.count_nonzero(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary())],
                        schema=_CODED,
                    )
        give_back()

    return _rows(docs).mapInArrow(number, "lang string, m long, ids binary")


def first_states(trie: Trie, start: int) -> np.ndarray:
    """The state reached from ``start`` by every symbol."""
    symbols = np.arange(int(trie.symbols[0]))
    return step(trie, np.full(len(symbols), start, np.int32), symbols)


def states_at(trie: Trie, first: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """The state of the ``depth`` symbols from every place on, all places moved level by level; ``first``: ``first_states``."""
    states = first[ids]
    for level in range(1, depth):
        states = step(trie, states[: max(0, len(ids) - level)], ids[level:])
    return states


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class _Met:
    """A task's counts of codes."""

    def __init__(self, shares: int):
        self.shares = shares
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.kept = 0

    def add(self, codes: np.ndarray) -> bool:
        """Whether so much is held that it should be passed on."""
        found, n = np.unique(codes, return_counts=True)
        self.codes.append(found)
        self.counts.append(n)
        self.kept += len(found)
        if self.kept <= HELD_PAIRS:
            return False
        self.codes, self.counts = map(list, zip(_summed(self.codes, self.counts)))
        self.kept = len(self.codes[0])
        return self.kept > HELD_PAIRS // 2

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        """All codes and counts, by shares; forgets them."""
        if self.codes:
            codes, counts = _summed(self.codes, self.counts)
            mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            share = (mixed % np.uint64(self.shares)).astype(np.int32)
            order = np.argsort(share, kind="stable")
            own, first = np.unique(share[order], return_index=True)
            bounds = [*first.tolist(), len(order)]
            for k, low, high in zip(own.tolist(), bounds, bounds[1:], strict=False):
                part = order[low:high]
                columns = [k], [codes[part].tobytes()], [counts[part].astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MET, strict=True)], schema=_MET)
        self.codes, self.counts, self.kept = [], [], 0


def walk(blocks: DataFrame, trie: Trie, roots: dict[str, int], depth: int, totals: dict[str, int], least: int, pairs: bool) -> DataFrame:
    """One pass over the numbered texts: how often tasks met pairs of neighbouring phrases of ``depth`` words.

    The code of a pair is the first phrase's node times the number of nodes plus the second's. Without
    ``pairs``, phrases themselves are counted, their nodes being the codes. ``totals`` are the words of
    each language; one of fewer than ``least`` is left out, as it has no phrase that often.
    """
    large = {lang: root for lang, root in roots.items() if totals[lang] >= least}
    shares = max(8, -(-sum(totals.values()) // SHARE_WORDS))
    sent = blocks.sparkSession.sparkContext.broadcast((*trie, large))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *arrays, starts = sent.value
        own = Trie(*arrays)
        met, wide, firsts = _Met(shares), len(own.slot), {}
        for batch in batches:
            for lang, ids in zip(batch.column("lang"), batch.column("ids"), strict=True):
                lang = lang.as_py()
                if lang not in starts:
                    continue
                if lang not in firsts:
                    firsts[lang] = first_states(own, starts[lang])
                # read where they lie: a batch may hold the ids of all texts of a task
                states = states_at(own, firsts[lang], np.frombuffer(ids.as_buffer(), np.int32), depth)
                if pairs:
                    both = np.flatnonzero((states[:-1] > 0) & (states[1:] > 0))
                    codes = own.node[states[both]].astype(np.int64) * wide + own.node[states[both + 1]]
                else:
                    codes = own.node[states[states > 0]].astype(np.int64)
                if met.add(codes):
                    yield from met.passed_on()
        yield from met.passed_on()
        del own, arrays, met, firsts
        give_back()

    return blocks.select("lang", "ids").mapInArrow(run, _MET_SQL)


def often_met(met: DataFrame, least: int) -> DataFrame:
    """``code, n`` of what all tasks of ``walk`` together met ``least`` times or more."""

    def add(share: pa.Table) -> pa.Table:
        codes = [np.frombuffer(x.as_buffer(), np.int64) for x in share.column("codes")]
        counts = [np.frombuffer(x.as_buffer(), np.int64) for x in share.column("counts")]
        code, n = _summed(codes, counts)
        made = pa.table([code[n >= least], n[n >= least]], schema=_OFTEN)
        del codes, counts, code, n
        give_back()
        return made

    return met.groupBy("share").applyInArrow(add, "code long, n long")


def _numpy(rows: DataFrame) -> dict[str, np.ndarray]:
    found = rows.toArrow()
    return {name: found.column(name).to_numpy() for name in found.column_names}


def count_phrases(docs: DataFrame, counts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame | None:
    """``lang, phrase, words, f`` of all phrases with at least ``least`` occurrences, single words included.

    ``counts`` is ``count_words(docs)``. None if the frequent phrases are too many to be sent to tasks.
    """
    spark = docs.sparkSession
    often = counts.where(F.col("n") >= least)
    if often.count() > MOST_WORDS:
        return None
    found = often.toArrow().to_pydict()
    # frequent words get small numbers, which keeps the trie dense
    words = list(dict.fromkeys(w for _, w in sorted(zip(found["n"], found["word"]), key=lambda x: (-x[0], x[1]))))
    number = {w: k + 1 for k, w in enumerate(words)}
    langs = sorted(set(found["lang"]))
    place = {lang: k + 1 for k, lang in enumerate(langs)}
    # node 0 is the root, then a node for every language, then phrases by length
    parent = np.concatenate([np.zeros(len(langs), np.int64), np.array([place[g] for g in found["lang"]], np.int64)])
    symbol = np.concatenate([np.arange(1, len(langs) + 1), np.array([number[w] for w in found["word"]], np.int64)])
    f = np.concatenate([np.zeros(len(langs) + 1, np.int64), np.array(found["n"], np.int64)])
    blocks = cut(encode(docs, words), **LARGE_ROWS)
    totals = {r["lang"]: r["m"] for r in blocks.groupBy("lang").agg(F.sum("m").alias("m")).where("m > 0").collect()}
    for depth in range(1, longest):
        trie = build(parent, symbol)
        roots = {lang: int(trie.slot[place[lang]]) for lang in langs if lang in totals}
        longer = cut(often_met(walk(blocks, trie, roots, depth, totals, least, pairs=True), least))
        if len(parent) + longer.count() > MOST_PHRASES:
            return None
        made = _numpy(longer.orderBy("code"))
        if not len(made["code"]):
            break
        a, b = np.divmod(made["code"], len(trie.slot))
        parent, symbol, f = np.concatenate([parent, a]), np.concatenate([symbol, symbol[b - 1]]), np.concatenate([f, made["n"]])
    return _spelled(spark, langs, words, parent, symbol, f)


def _spelled(spark, langs: list[str], words: list[str], parent: np.ndarray, symbol: np.ndarray, f: np.ndarray) -> DataFrame:
    """The phrases of the trie's nodes as rows, spelled by tasks."""
    sent = spark.sparkContext.broadcast((langs, words, parent, symbol, f))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, spelled, above, last, counts = sent.value
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                node, own = k, []
                while above[node - 1]:
                    own.append(spelled[last[node - 1] - 1])
                    node = int(above[node - 1])
                out.append((names[node - 1], " ".join(reversed(own)), len(own), int(counts[k])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        give_back()

    return spark.range(len(langs) + 1, len(f)).mapInArrow(spell, "lang string, phrase string, words int, f long")


def count_shuffled(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """The rows of ``count_phrases`` by one grouping of all phrases, for any number of them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = _rows(docs).withColumn("text", F.translate("text", upper, upper.lower()))
    pieces = lowered.select("lang", F.explode(F.split("text", r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    listed = pieces.select("lang", F.expr(r"filter(split(piece, '[ \t]+'), w -> w <> '')").alias("w"))
    every = F.expr(
        f"flatten(transform(sequence(1, least(size(w), {longest})), k -> transform(sequence(1, size(w) - k + 1), "
        "i -> struct(k AS words, array_join(slice(w, i, k), ' ') AS phrase))))"
    )
    rows = listed.where("size(w) > 0").select("lang", F.explode(every).alias("p")).select("lang", "p.*")
    counted = rows.groupBy("lang", "phrase", "words").agg(F.count("*").alias("f"))
    return counted.where(F.col("f") >= least).select("lang", "phrase", "words", "f")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact."""
    wide = [c.cast("decimal(18,0)") for c in (a, n, left, right)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide[0] * wide[1]).cast("decimal(33,0)"), wide[2] * wide[3])


def rank_phrases(frequent: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of every language, from all frequent phrases and the words of each language.

    A phrase as frequent as one that is a word longer and holds it is left out. Checking one word more
    is enough: counts cannot grow from there to still longer phrases.
    """
    frequent = cut(frequent)
    phrases = frequent.where("words > 1")
    words = F.split("phrase", " ")

    def part(low, size) -> Column:
        return F.array_join(F.slice(words, low, size), " ")

    cuts = phrases.select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select("*", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left = frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(F.broadcast(totals), "lang")
    scored = scored.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).cast("long"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"), F.first("n").alias("n")
    )
    longer = phrases.where("words > 2")
    inside = longer.select("lang", part(1, F.col("words") - 1).alias("phrase"), "f").unionByName(
        longer.select("lang", part(2, F.col("words") - 1).alias("phrase"), "f")
    )
    holding = inside.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = best.join(holding, ["lang", "phrase"], "left").where("held IS NULL OR held < a")
    flat = kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return top_k(flat, ["lang"], order, top, "rank").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of every language."""
    counts = cut(count_words(docs))
    totals = cut(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = count_phrases(docs, counts, least, longest)
    if frequent is None:
        frequent = count_shuffled(docs, least, longest)
    return rank_phrases(frequent, totals, top)


ORACLE_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
c AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE f >= 100),
s AS (
  SELECT p.lang, p.phrase, p.k, p.f AS a, x.f AS l, y.f AS r, n.n,
         (1000::HUGEINT * p.f * n.n // (x.f::HUGEINT * y.f))::BIGINT AS score, j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) p
  JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.ws[1 : j], ' ')
  JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.ws[j + 1 : p.k], ' ')
  JOIN n ON n.lang = p.lang),
b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
g AS (
  SELECT b.* FROM b WHERE NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.f >= 100 * b.a
      AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM g)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""

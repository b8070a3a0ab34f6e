"""Quality rules kept as a ledger: every rule is evaluated once per document.

``ledger`` stores the measurements and one bit per failed rule. A policy is a versioned set of
rules, so applying one, or comparing many, is a mask on the stored bits and never reads the texts
again. ``ablations`` sums the distinct bit patterns (at most 2 to the number of rules).

Defined cases: a null or empty text has no words (it fails ``few_words``); lines count only if they
hold a word; repeated rows each get their own row; an empty table gives an empty ledger. All rules
are exact whole-number comparisons on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import by_rows, give_back, window_ids, word_ids

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Rule name and the condition, on the measures, under which a document fails it.
# The place in this list is the rule's bit.
RULES = (
    ("few_words", lambda m: m("n_words") < 20),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    ("symbols", lambda m: 100 * m("n_symbols") > 20 * m("n_words")),
    ("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    ("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
    ("repeated_lines", lambda m: (m("n_dup_lines") >= 3) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
)
BITS = {name: 1 << place for place, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[rule] for rule in self.rules)


# A new version is appended; an old one is never edited, so that old decisions can be repeated.
POLICIES = (
    Policy("base", 1, ("few_words", "repeated_words")),
    Policy("standard", 1, ("few_words", "repeated_words", "symbols", "repeated_lines")),
    Policy("standard", 2, tuple(BITS)),
)
BASE, STANDARD = POLICIES[0], POLICIES[-1]

_SCHEMA = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in MEASURES)])


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    keys = window_ids(word_ids(words), size)
    if len(keys) < 2:
        return 0
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[place] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measure_text(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure(row: tuple) -> list[tuple]:
    return [(row[0], *measure_text(row[1]))]


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of every row of ``docs``; no shuffle."""
    schema = "doc_id long, " + ", ".join(f"{name} long" for name in MEASURES)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_rows(_measure, _SCHEMA), schema)


def fail_bits(m: Callable[[str], Column]) -> Column:
    """The ledger's bits, from a function that gives the column of a measure."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements plus ``fail_bits``: bit k is set if rule k of ``RULES`` fails."""
    return measure(docs).withColumn("fail_bits", fail_bits(F.col))


def failed(policy: Policy):
    """Column: does a ledger row fail any rule of the policy?"""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """``base_failed`` and ``kept`` under a policy, from the stored bits alone."""
    return rows.withColumn("base_failed", failed(BASE)).withColumn("kept", ~failed(BASE) & ~failed(policy))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: rows rejected, rows failing the rule, rows only this rule rejects.

    One counting shuffle of bit patterns; everything else is arithmetic on at most
    2^len(RULES) rows.
    """
    cases = F.array(
        *(
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(p.version).alias("version"),
                F.lit(rule).alias("rule"),
                F.lit(BITS[rule]).cast("long").alias("bit"),
                F.lit(p.mask).cast("long").alias("mask"),
            )
            for p in policies
            for rule in p.rules
        )
    )
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))

    def total(when):
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")

    return (
        patterns.select("fail_bits", "n", F.explode(cases).alias("c"))
        .groupBy("c.policy", "c.version", "c.rule")
        .agg(
            total(hit != 0).alias("rejected"),
            total(F.col("fail_bits").bitwiseAND(F.col("c.bit")) != 0).alias("failing"),
            total(hit == F.col("c.bit")).alias("only_this"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns, in one pass without a join.

    A row whose ``doc_id`` is null is judged like any other.
    """
    place = [name.lower() for name in docs.columns].index("text")
    own = "_measures"
    while own in docs.columns:
        own += "_"
    kind = pa.struct([(name, pa.int64()) for name in MEASURES])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time becomes a Python string
            found = [dict(zip(MEASURES, measure_text(t.as_py()), strict=True)) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, kind)], [*batch.schema.names, own]
            )
        give_back()

    measures = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])
    rows = docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(own, measures)]))
    bits = fail_bits(lambda name: F.col(own)[name])
    return rows.where(bits.bitwiseAND(F.lit(BASE.mask | policy.mask)) == 0).drop(own)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, unnest(range(1, len(words) - 6)) AS i,
           unnest(list_transform(range(1, len(words) - 6), lambda k: array_to_string(words[k : k + 7], ' '))) AS g
    FROM w WHERE len(words) >= 8)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)) AS kept
FROM f
"""

"""The training-data pipeline: five stages over ``documents``, each on what the one before it kept.

1. quality rules: rows the standing policy rejects go;
2. n-gram Jaccard join: of each group of near duplicates (shingles of five words, 0.8; the query
   op9 has limits of its own) the row with the smallest id stays;
3. benchmark decontamination: rows that hold a test item go;
4. mixing: rows are left out, kept or repeated so that sources come near their target weights;
5. token ids: what is left is encoded, packed, written, and read back per document.

All but the last stage return the columns of their input. ``run`` writes every stage's rows to the
shared folder and goes on from there. SQL cannot express stages 3 and 5, so ``ORACLE_SQL`` is None;
``tests/llm`` compares stage 2 with brute force, the others with their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, jaccard, mixing, rules, tokens
from docloom.llm.common import cut, table


# Words of a shingle and least similarity of near duplicates in the corpus.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

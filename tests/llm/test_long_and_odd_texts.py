"""Every operator and stage on nulls, blanks, ties, repeated rows and a text of megabytes, beside ordinary documents."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontaminate, jaccard, language, licenses, mixing, quality, repeats, rules, tokens, toxicity


@pytest.fixture(scope="module")
def mixed(spark, given, odd_docs):
    """The given documents and the odd ones, whose ids are negative here; models are fitted on the given ones."""
    columns = given.columns
    odd = odd_docs.select((-F.col("doc_id")).alias("doc_id"), *(F.col(c) for c in columns[1:]))
    extra = [c for c in odd_docs.columns if c not in columns]
    rows = given.unionByName(odd.select(*columns)).withColumns({c: F.lit(1) for c in extra})
    path = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/mixed-{id(odd)}"
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return collections.Counter(r[0] for r in df.select("doc_id").collect())


def test_each_operator_keeps_every_row(mixed):
    expected = ids(mixed)
    for found in (
        tokens.encode_corpus(mixed), mixing.mix(mixed), quality.score(mixed), repeats.strip(mixed), licenses.scan(mixed),
        language.identify(mixed), jaccard.link(mixed), rules.ledger(mixed),
    ):
        assert ids(found) == expected


def test_a_fitted_language_model_on_odd_rows(mixed):
    rows = collections.defaultdict(set)
    for r in language.identify(mixed).collect():
        rows[r.doc_id].add((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    assert {p for k in (-4, -5, -6) for p, _ in rows[k]} == {"und"}
    assert len(rows[-8]) == 1 and len(rows[-13]) == 1


def test_a_fitted_toxicity_model_on_odd_rows(spark, sf, mixed):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    odd = spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id long, toxic int")
    found = toxicity.score(mixed, labels.unionByName(odd.select(*(F.col(c).cast(t) for c, t in labels.dtypes)))).collect()
    assert collections.Counter(r.doc_id for r in found) == ids(mixed)
    by = collections.defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.score, r.predicted))
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
    # without characters there is no difference: one score for all such rows
    assert len(by[-4] | by[-5] | by[-6]) == 1 and len(by[-8]) == 1


def test_stages_on_odd_rows(spark, sf, mixed):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, mixed, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == mixed.columns
        # what a stage keeps it keeps as it is; the mix repeats rows
        assert set(ids(found)) <= set(ids(mixed))
    kept = set(ids(dict(corpus_pipeline.STAGES)["quality rules"](spark, mixed, sf)))
    assert {-13, -10} <= kept and not {-4, -5, -6, -9} & kept


def test_long_texts_are_searched_to_their_end(spark, odd_docs):
    """An item at the end of a text of megabytes is found."""
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    long = odd_docs.where("doc_id = 13").select("doc_id", F.concat("text", F.lit(f" {item}")).alias("text"))
    benchmark = spark.createDataFrame([(1, item), (2, "an item that is nowhere to be found in any text")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(long, benchmark).select("doc_id", "item_id").collect()] == [(13, 1)]

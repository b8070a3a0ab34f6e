"""The pipeline, stage by stage, against the operators' own results on the stage's input."""

import collections

import corpus_pipeline
from docloom.llm import decontaminate, jaccard, mixing, rules


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    (_, clean), (_, unique), (_, apart), (_, mixed), (_, encoded) = corpus_pipeline.STAGES

    def ids(df):
        return collections.Counter(r.doc_id for r in df.select("doc_id").collect())

    one = clean(spark, docs, sf).cache()
    assert ids(one) == ids(rules.apply_policy(rules.ledger(docs)).where("kept"))
    two = unique(spark, one, sf).cache()
    assert ids(two) == ids(jaccard.link(one).where("doc_id = component_id"))
    three = apart(spark, two, sf).cache()
    leaked = {r.doc_id for r in decontaminate.matches(two, benchmark).collect()}
    assert set(ids(three)) == set(ids(two)) - leaked and leaked
    four = mixed(spark, three, sf).cache()
    assert ids(four) == {r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies}
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    last = encoded(spark, four, sf)
    assert ids(last) == ids(four) == ids(corpus_pipeline.run(spark, sf))

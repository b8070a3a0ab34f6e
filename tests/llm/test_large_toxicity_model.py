"""Toxicity by a model that is too large to send: no counted n-gram is left out."""

import numpy as np
import pytest

from docloom.llm import toxicity


@pytest.mark.parametrize("block", [1, 2000])
def test_scores_do_not_depend_on_how_much_is_sent(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    given, labels = [], []
    for k in range(400):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["ba", "lo", "mi"], 40), rng.choice(["na", "ro", "ken"], 40), strict=True)]
        if k % 5 == 0:  # an expression of few documents
            words[7] = f"gruzz{k % 3}"
        given.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    given += [(1000, None), (1001, ""), (None, "gruzz1 bana"), (None, "gruzz1 bana"), (1002, "never seen ☃☃☃☃☃☃"), (7, "another text")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")

    def scores():
        return sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9), r.predicted) for r in toxicity.score(docs, marks).collect())

    sent = scores()
    monkeypatch.setattr(toxicity.count, "__defaults__", (50,))
    monkeypatch.setattr(toxicity, "BLOCK", block, raising=False)
    assert scores() == sent and len(sent) == len(given)

"""The character models against plain counting: probabilities, sums, differences of whole texts."""

import math
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import toxicity
from docloom.llm.decontaminate import normalised


def plain(text):
    data = normalised(text)
    return f" {data.decode()} " if data else ""


class Plain:
    """Interpolated Kneser-Ney by dictionaries, straight from the definition."""

    def __init__(self, rows, order=toxicity.ORDER, shared=toxicity.SHARED, discount=toxicity.DISCOUNT):
        self.order, self.discount = order, discount
        types = [[defaultdict(int), defaultdict(int)] for _ in range(order + 1)]
        for text, c in rows:
            t = plain(text)
            if len(t) < order:
                continue
            for size in range(1, order + 1):
                for g in {t[i : i + size] for i in range(len(t) - size + 1)}:
                    types[size][c][g] += 1
        self.letters = len({*types[1][0], *types[1][1]}) + 1
        self.n = [[defaultdict(int), defaultdict(int)] for _ in range(order + 1)]
        for c in (0, 1):
            self.n[order][c] = types[order][c]
            for size in range(1, order):
                longer = {*types[size + 1][0], *types[size + 1][1]} if size <= shared else set(types[size + 1][c])
                for g in longer:
                    self.n[size][c][g[1:]] += 1
        self.after = [[defaultdict(list), defaultdict(list)] for _ in range(order + 1)]
        for size in range(1, order + 1):
            for c in (0, 1):
                for g, k in self.n[size][c].items():
                    self.after[size][c][g[:-1]].append(k)

    def weight(self, c, history):
        found = self.after[len(history) + 1][c].get(history)
        return self.discount * len(found) / sum(found) if found else 1.0

    def p(self, c, gram):
        if not gram:
            return 1 / self.letters
        found = self.after[len(gram)][c].get(gram[:-1])
        own = max(self.n[len(gram)][c].get(gram, 0) - self.discount, 0) / sum(found) if found else 0.0
        return own + self.weight(c, gram[:-1]) * self.p(c, gram[1:])


def corpus(seed, n=40):
    rng = np.random.default_rng(seed)
    parts = ["ba", "lo", "mi", "né", "  ", "x!", "日"]
    rows = [(" ".join("".join(rng.choice(parts, 3)) for _ in range(int(rng.integers(0, 9)))), int(k % 3 == 0)) for k in range(n)]
    return [*rows, (None, 1), ("", 0), ("ab", 1), ("gruzz gruzz", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus(1)


@pytest.fixture(scope="module")
def learn(spark, rows):
    return spark.createDataFrame(rows, "text string, toxic int").repartition(3)


def key_of(gram):
    points = np.frombuffer(gram.encode("utf-32-le"), "<u4").astype(np.uint64)
    return int(toxicity.grams(points, len(gram))[0]) if gram else 0


def test_probabilities_by_hand(learn, rows):
    model = Plain(rows)
    found, weights = toxicity.probabilities(learn)
    own = {(r["size"], r.key): (r.p0, r.p1) for r in found.collect()}
    every = {g for text, _ in rows for t in [plain(text)] if len(t) >= model.order for k in range(1, model.order + 1) for g in (t[i : i + k] for i in range(len(t) - k + 1))}
    assert set(own) == {(len(g), key_of(g)) for g in every}
    for g in every:
        for c in (0, 1):
            assert math.isclose(own[len(g), key_of(g)][c], model.p(c, g), rel_tol=1e-9)
    left = {(r["size"], r.history): (r.l0, r.l1) for r in weights.collect()}
    for g in every:
        for c in (0, 1):
            assert math.isclose(left[len(g), key_of(g[:-1])][c], model.weight(c, g[:-1]), rel_tol=1e-9)


def test_probabilities_sum_to_one(learn, rows):
    model = Plain(rows)
    letters = {x for text, _ in rows if len(plain(text)) >= model.order for x in plain(text)}
    assert len(letters) + 1 == model.letters
    found, _ = toxicity.probabilities(learn)
    assert found.count() > 50
    histories = {t[i : i + k] for text, _ in rows for t in [plain(text)] for k in range(model.order) for i in range(len(t) - k)}
    for h in [*histories, "zzzz", "ba", ""]:
        for c in (0, 1):
            # all letters, and the one that stands for those never seen
            assert math.isclose(sum(model.p(c, h + x) for x in letters) + model.p(c, h + "￿"), 1, rel_tol=1e-9)


def test_differences_of_texts_by_hand(learn, rows):
    model = Plain(rows)
    scorer = toxicity.Scorer(*toxicity.count(learn).grams)
    for text in [*(t for t, _ in rows), "never seen ☃ words gruzz", "ba lo mi gruzzba", "x" * 30]:
        t = plain(text)
        expected = [math.log(model.p(1, t[i : i + model.order]) / model.p(0, t[i : i + model.order])) for i in range(len(t) - model.order + 1)]
        assert np.allclose(scorer.differences(toxicity.characters(text)), expected, atol=1e-9)


def test_lookup():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        keys = rng.choice(5000, n, replace=False).astype(np.int64) * 7 - 9000
        asked = np.arange(-9100, 30000)
        place = {int(k): i for i, k in enumerate(keys)}
        assert toxicity.Lookup(keys).find(asked).tolist() == [place.get(int(k), -1) for k in asked]

"""The pipeline's near-duplicate stage against brute force over all pairs."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from docloom.llm import jaccard


@pytest.mark.parametrize("size", [1, 4, 5])
def test_sets_of_a_column_are_those_of_its_texts(size):
    rng = np.random.default_rng(size)
    texts = [None, "", " \n", "a", "A b", "é É ß", "\x00 a \x1c b", *(" ".join(rng.choice(list("abCD"), n)) for n in range(30))]
    for column in (pa.array(texts), pa.array(["x y", *texts, "z"])[1:-1]):
        found = list(jaccard.shingle_sets(column, size))
        assert [x.tolist() for x in found] == [jaccard.shingles(t, size).tolist() for t in texts]


def shingles(text, size=5):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [w for w in (text or "").translate(low).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def first_of_each_group(given):
    sets = {key: shingles(text) for key, text in given}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {key for key in keys if find(key) == key}


def test_near_duplicates_by_brute_force(spark):
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    base = [f"w{k}" for k in range(100)]
    given = [(1, " ".join(base))]
    for n in range(1, 40):  # copies whose last n words differ: similar from far above to far below the limit
        given.append((100 + n, " ".join(base[:-n] + [f"x{n}y{k}" for k in range(n)])))
    for n in (50, 51):  # one word changed within n words
        words = [f"v{n}w{k}" for k in range(n)]
        given += [(1000 + n, " ".join(words)), (2000 + n, " ".join([*words[:20], "other", *words[21:]]))]
    given += [(3000, "A b"), (3001, "a B"), (3002, None), (3003, "")]
    kept = stage(spark, spark.createDataFrame(given, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == first_of_each_group(given)

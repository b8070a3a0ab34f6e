"""Shingles that documents of other sizes share by chance are not carried through the Jaccard join."""

import random

from docloom.llm import jaccard


def fit(a, b, percent):
    (na, pa), (nb, pb) = a[1:], b[1:]
    long = 100 * min(na, nb) >= percent * max(na, nb)
    return a[0] != b[0] and long and (100 + percent) * min(na - pa, nb - pb) >= percent * (na + nb)


def test_only_rows_that_may_link_stay(spark):
    rng = random.Random(5)
    rows = []
    for shingle in range(600):
        for doc in rng.sample(range(5000), rng.choice([1, 2, 2, 2, 3, 5, 40])):
            n = rng.choice([rng.randint(1, 3000), rng.randint(90, 110)])
            rows.append((shingle, 1, doc, n, rng.randint(0, n // 5)))
    rows += [(-1, 2, doc, 10 * 3**doc, 0) for doc in range(6)]  # in parts: left as it is
    given = spark.createDataFrame(rows, "shingle long, parts int, doc long, n int, pos int")
    for percent in (80, 85):
        kept = {(r.shingle, r.doc) for r in jaccard._grouped(given, percent).collect()}
        by_shingle = {}
        for shingle, _, *row in rows:
            by_shingle.setdefault(shingle, []).append(tuple(row))
        needed = {(s, a[0]) for s, own in by_shingle.items() for a in own if s < 0 or any(fit(a, b, percent) for b in own)}
        assert needed <= kept
        # of two rows, exactly those that pass stay
        pairs = {s for s, own in by_shingle.items() if len(own) < 3}
        assert {x for x in kept if x[0] in pairs} == {x for x in needed if x[0] in pairs}
        assert len(kept) < 0.8 * len(rows)


def test_rows_are_moved_once_and_narrow(spark):
    given = spark.createDataFrame([(1, 1, 1, 10, 0)], "shingle long, parts int, doc long, n int, pos int")
    plan = jaccard._grouped(given, 80)._jdf.queryExecution().executedPlan()
    lines = plan.toString().split("\n")
    at = [k for k, line in enumerate(lines) if "Exchange " in line]
    assert len(at) == 1 and "struct" not in "\n".join(lines[at[0] :])

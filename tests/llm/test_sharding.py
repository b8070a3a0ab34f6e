"""Shards: exact sizes, uniform assignments, no row lost."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from docloom.llm import sharding


def test_matrix_fills_rows_and_columns():
    rng = np.random.default_rng(0)
    for _ in range(200):
        senders = rng.integers(0, 30, rng.integers(1, 9)).tolist()
        room = sharding.shard_sizes(sum(senders), int(rng.integers(1, 8)))
        rows = list(sharding.draw_matrix(rng, senders, room))
        assert [sum(r) for r in rows] == senders
        assert [sum(c) for c in zip(*rows)] == room and max(room) - min(room) <= 1


def test_matrix_has_the_law_of_a_uniform_shuffle():
    """Senders of 2, 1 and 3 rows into 2 shards of 3: all 20 ways to pick a shard's rows are equally likely."""
    owner = [0, 0, 1, 2, 2, 2]
    law = collections.Counter()
    for chosen in itertools.combinations(range(6), 3):
        law[tuple(sum(owner[i] == s for i in chosen) for s in range(3))] += 1 / 20
    rng = np.random.default_rng(1)
    draws = 20_000
    seen = collections.Counter(tuple(r[0] for r in sharding.draw_matrix(rng, [2, 1, 3], [3, 3])) for _ in range(draws))
    assert set(seen) == set(law)
    distance = sum((seen[k] - draws * p) ** 2 / (draws * p) for k, p in law.items())
    assert distance < 30  # five degrees of freedom


def test_draws_from_large_populations():
    """The sampler for populations that numpy refuses, held against numpy on a small one."""
    rng = np.random.default_rng(2)
    good, bad, n = 40, 70, 30
    own = [sharding.hypergeometric(rng, good, bad, n, most=0) for _ in range(20_000)]
    weights = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)]
    seen = np.bincount(own, minlength=n + 1)
    likely = [k for k in range(n + 1) if weights[k] * len(own) > 5]
    distance = sum((seen[k] - len(own) * weights[k]) ** 2 / (len(own) * weights[k]) for k in likely)
    assert distance < 3 * len(likely)
    huge = np.array([sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**9) for _ in range(300)], float)
    spread = math.sqrt(10**9 * 0.25 * 0.75 * (1 - 1 / 400))
    assert abs(huge.mean() - 2.5e8) < 5 * spread / math.sqrt(300)
    assert 0.8 < huge.std() / spread < 1.2
    assert sharding.hypergeometric(rng, 0, 10**10, 5) == 0 and sharding.hypergeometric(rng, 10**10, 0, 5) == 5


@pytest.mark.parametrize("n,parts,shards", [(0, 3, 24), (1, 1, 24), (23, 5, 24), (25, 4, 24), (1000, 7, 24), (500, 3, 1)])
def test_sizes_and_slots(spark, n, parts, shards):
    rows = spark.range(n, numPartitions=parts).withColumnRenamed("id", "doc_id")
    found = sharding.deal(rows, shards).collect()
    assert sorted(r.doc_id for r in found) == list(range(n))
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert [len(by[k]) for k in range(shards)] == sharding.shard_sizes(n, shards)
    assert all(sorted(own) == list(range(len(own))) for own in by.values())


def test_blocks_smaller_than_a_partition(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 4)
    monkeypatch.setattr(sharding, "BLOCK", 16)
    rows = spark.range(1000, numPartitions=3).withColumnRenamed("id", "doc_id")
    found = sharding.deal(rows, 7, seed=5)
    again = sharding.deal(rows, 7, seed=5)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in again.collect()}
    other = sharding.deal(rows, 7, seed=6)
    assert {tuple(r) for r in found.collect()} != {tuple(r) for r in other.collect()}


def test_neighbours_are_spread(spark):
    """Over seeds, a row's shard and its place in it do not depend on where it was read."""
    rows = spark.range(40, numPartitions=4).withColumnRenamed("id", "doc_id")
    first = np.zeros(40)
    seeds = 12
    for seed in range(seeds):
        for r in sharding.deal(rows, 4, seed).where("slot < 5").collect():
            first[r.doc_id] += 1
    # each row lies in the first half of its shard half of the time
    assert abs(first.sum() - 20 * seeds) < 1e-9
    assert ((first - seeds / 2) ** 2 / (seeds / 4)).sum() < 85  # 39 degrees of freedom


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    found = sharding.assign(odd_docs)
    expected = collections.Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
        for r in odd_docs.select("doc_id", "text").collect()
    )
    rows = found.collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sharding.assign(no_docs).count() == 0
    whole = sharding.deal(odd_docs, 5)
    assert sorted(whole.columns) == sorted(odd_docs.columns)
    same = [c for c in odd_docs.columns if c not in ("shard", "slot")]
    strip = lambda df: collections.Counter(str(tuple(r)) for r in df.select(*same).collect())
    assert strip(whole) == strip(odd_docs)
    sharding.write_shards(odd_docs, str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert strip(back) == strip(odd_docs)
    assert {tuple(r) for r in back.select("shard", "slot").collect()} == {tuple(r) for r in whole.select("shard", "slot").collect()}

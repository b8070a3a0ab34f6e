"""Collocations against plain counting, and the trie against a dictionary."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import phrases, tries


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_what_was_put_in(seed):
    rng = np.random.default_rng(seed)
    n, letters = int(rng.integers(1, 4000)), int(rng.integers(1, 300))
    known = {(): 0}
    parent, symbol = [], []
    paths = [()]
    for _ in range(n):
        path = (*paths[int(rng.integers(0, len(paths)) * rng.random() ** 2)], int(rng.integers(1, letters + 1)))
        if path not in known:
            parent.append(known[path[:-1]])
            symbol.append(path[-1])
            known[path] = len(parent)
            paths.append(path)
    trie = tries.build(np.array(parent), np.array(symbol))
    states = np.full(letters + 1, tries.ROOT)
    for path, node in known.items():
        at = trie.slot[node]
        assert trie.node[at] == node
        to = tries.step(trie, np.full(letters + 1, at), np.arange(letters + 1))
        expected = [known.get((*path, c), -1) for c in range(letters + 1)]
        assert np.where(to == tries.DEAD, -1, trie.node[to]).tolist() == expected
    assert (tries.step(trie, np.zeros_like(states), np.arange(letters + 1)) == tries.DEAD).all()


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(rb"[.,;:!?\n-\r]", (text or "").encode().lower()):
            words = re.findall(rb"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, totals


def plain_collocations(rows, least, top):
    counts, totals = plain_counts(rows)
    often = {key: f for key, f in counts.items() if f >= least}
    longer = {}
    for (lang, words), f in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = lang, words[i : i + k]
                longer[key] = max(longer.get(key, 0), f)
    out = []
    for (lang, words), a in often.items():
        if len(words) < 2 or longer.get((lang, words), 0) >= a:
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (often[lang, words[:k]] * often[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, b" ".join(words), a, often[lang, words[:k]], often[lang, words[k:]], n, score))
    found = set()
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1]))[:top]
        found |= {(lang, place + 1, r[1].decode(), *r[2:]) for place, r in enumerate(own)}
    return found


def corpus(seed):
    rng = np.random.default_rng(seed)
    fixed = ["New York City", "a b a b a", "of the the the", "é l’été", "x, y; z"]
    rows = []
    for _ in range(80):
        words = [f"w{int(k)}" for k in rng.zipf(1.6, int(rng.integers(0, 60))) if k < 40]
        for _ in range(int(rng.integers(0, 5))):
            words.insert(int(rng.integers(0, len(words) + 1)), fixed[int(rng.integers(0, len(fixed)))])
        rows.append((["en", "fr", None][int(rng.integers(0, 3))], " ".join(words) + rng.choice(["", ".", "\n", " \t"])))
    return rows


@pytest.mark.parametrize("seed,parts,held", [(0, 1, 1 << 21), (1, 5, 1 << 21), (2, 3, 40)])
def test_collocations_by_counting(spark, monkeypatch, seed, parts, held):
    monkeypatch.setattr(phrases, "HELD_PAIRS", held)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    for least, top in ((4, 2000), (9, 5)):
        found = {tuple(r) for r in phrases.collocations(docs, least, top=top).collect()}
        assert found == plain_collocations(rows, least, top)
    assert any(len(r[2].split()) == 5 for r in plain_collocations(rows, 4, 2000))


def test_candidates_are_refused_only_when_safe(spark):
    """Many small tasks: each passes on little, yet no frequent phrase is missed."""
    rows = [("en", "a b c d e")] * 12 + [("en", f"u{k} v{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(24)
    frequent = phrases.count_phrases(docs, phrases.count_words(docs), least=12)
    counts, _ = plain_counts(rows)
    assert {(r.phrase.encode(), r.f) for r in frequent.collect()} == {
        (b" ".join(w), f) for (_, w), f in counts.items() if f >= 12
    }


def test_shuffled_counts_are_the_same(spark, given, monkeypatch):
    counts = phrases.count_words(given).cache()
    by_trie = {tuple(r) for r in phrases.count_phrases(given, counts, least=20).collect()}
    assert {tuple(r) for r in phrases.count_shuffled(given, least=20).collect()} == by_trie
    assert {r[2] for r in by_trie} == {1, 2, 3, 4, 5}
    monkeypatch.setattr(phrases, "MOST_PHRASES", 10)
    assert phrases.count_phrases(given, counts, least=20) is None
    beyond = {tuple(r) for r in phrases.collocations(given, least=20).collect()}
    monkeypatch.setattr(phrases, "MOST_PHRASES", 1 << 21)
    assert {tuple(r) for r in phrases.collocations(given, least=20).collect()} == beyond


def test_scores_are_exact(spark):
    values = [(10**12 + 7, 10**13 + 1, 10**12 + 9, 3 * 10**12 + 1), (100, 10**15, 100, 100), (1, 1, 3, 7), (99, 101, 100, 100)]
    rows = spark.createDataFrame(values, "a long, n long, l long, r long")
    found = rows.select("a", "n", "l", "r", phrases._score(*(F.col(c) for c in "anlr")).cast("long").alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in found) and len(found) == 4


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    found = {tuple(r) for r in phrases.collocations(odd_docs, least=50).collect()}
    assert found == plain_collocations(rows, 50, 2000)
    assert any(r[2] == "over and over again we" for r in found) and any(r[2].startswith("the cat") for r in found)
    assert phrases.collocations(no_docs).count() == 0

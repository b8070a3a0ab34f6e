"""Periodic runs against a plain search for every period."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import periodic
from docloom.llm.words import slices, split


def plain_runs(words, most=None):
    """Every (start, length, period), by trying every period."""
    n, found = len(words), {}
    for q in range(1, min(n // 4, most or n) + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_of_random_texts():
    rng = np.random.default_rng(0)
    seen = Counter()
    for turn in range(150):
        texts = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 900 if turn % 2 else 60))
            words = rng.integers(0, rng.choice([1, 2, 3, 50]), n)
            for _ in range(rng.integers(0, 4)):
                if n > 8:
                    p, a = int(rng.integers(1, max(2, n // 4))), int(rng.integers(0, n))
                    words[a:] = np.resize(words[a : a + p], n - a) if rng.random() < 0.5 else words[a:]
            texts.append(words)
        first = np.cumsum([0, *(len(t) for t in texts)])
        text, runs = periodic.runs_of(np.concatenate(texts).astype(np.int64), first)
        for k, words in enumerate(texts):
            expected = plain_runs(words.tolist())
            assert [tuple(r) for r in runs.T[text == k].tolist()] == expected
            seen.update(q > periodic.SHORT for _, _, q in expected)
    assert seen[True] > 30 and seen[False] > 100


def test_equal_hashes_do_not_make_runs(monkeypatch):
    """With hashes that are all equal, seeds are extended too far; the words decide."""
    words = np.concatenate([np.arange(40), np.tile(np.arange(20), 6), np.arange(100, 150)])
    expected = plain_runs(words.tolist())
    hashes = periodic._Stretches(words)
    monkeypatch.setattr(periodic._Stretches, "at", lambda self, places, length: np.zeros(len(places), np.uint64))
    made = periodic._extended(words, hashes, np.array([60]), np.array([20]))
    assert [tuple(x) for x in made.T.tolist()] == expected == [(40, 120, 20)]


@pytest.mark.parametrize("lower", [False, True])
def test_split_agrees_with_regular_expressions(lower):
    texts = ["", None, "a", " a  b ", "One,two.three\nfour \t x", ".,", "é日 \x1c  ü", "end.", ".start", "A\x00B"]
    stops = b".,;:!?\n\x0b\x0c\r"
    for column in (pa.array(texts), pa.array(["skip", *texts])[1:]):
        parts = split(column, b" \t", stops, lower)
        words = parts.words.to_pylist()
        for k, text in enumerate(texts):
            raw = (text or "").encode()
            raw = raw.lower() if lower else raw
            pieces = [re.findall(rb"[^ \t]+", p) for p in re.split(rb"[.,;:!?\n-\r]", raw)]
            low, high = parts.first[k], parts.first[k + 1]
            assert words[low:high] == [w for p in pieces for w in p]
            assert sorted(Counter(parts.piece[low:high].tolist()).values()) == sorted(len(p) for p in pieces if p)
        assert len(set(parts.piece.tolist())) == sum(
            bool(p.strip(" \t")) for t in texts for p in re.split("[.,;:!?\n-\r]", t or "")
        )
        covered = [k for a, b in slices(column.fill_null(""), 4) for k in range(a, b)]
        assert covered == list(range(len(texts)))


def plain_row(key, text, most=None):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, most)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return key, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_on_given_rows(given):
    found = periodic.digests(periodic.find_runs(periodic.with_planted_runs(given)))
    docs = [r for r in given.collect() if len(r.text or "") < 6000]
    rows = {tuple(r) for r in found.collect()}
    assert found.count() == given.count()
    assert {plain_row(r.doc_id, r.text) for r in docs} <= rows


def test_odd_rows(odd_docs, no_docs):
    found = periodic.digests(periodic.find_runs(odd_docs))
    # the long text's only periods are short: 250,000 random words, then a phrase of six words
    expected = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        words = (r.text or "").encode().split()
        expected[(r.doc_id, len(plain_runs(words, 12)))] += 1
    assert Counter((r.doc_id, r.n_runs) for r in found.collect()) == expected
    by = {r.doc_id: r for r in periodic.find_runs(odd_docs).collect()}
    assert by[4].runs == [] and by[4].collapsed == "" and by[6].collapsed == ""
    assert by[9].collapsed == "a" and by[9].runs[0].asDict() == {"start": 0, "length": 3000, "period": 1}
    assert by[13].collapsed.endswith(" over and over again we go") and by[13].runs[-1].period == 6
    assert by[14].collapsed == "\x00 a\x00b \x00"
    planted = periodic.with_planted_runs(odd_docs)
    assert planted.count() == odd_docs.count()
    assert periodic.digests(periodic.find_runs(periodic.with_planted_runs(no_docs))).count() == 0
    assert periodic.collapse(no_docs).columns == ["doc_id", "text"]

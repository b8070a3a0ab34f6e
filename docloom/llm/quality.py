"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their votes overlap, so
expectation-maximisation over the counts of vote patterns (at most 3^labellers rows, whatever the
corpus size) estimates how often each is right, without any true label. The posteriors of the
patterns then serve as soft labels for a hashed linear scorer of words, which also judges documents
on which the labellers are silent.

The scorer is fitted on at most ``PER_SIDE`` documents of each side (smallest id hash); patterns,
posteriors and scores cover all rows and whole texts.

Defined cases: a null or empty text has no words and is scored from the bias alone; if no pattern
leans to one side, every score is the prior; repeated rows each get their row; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, hash60, hashed_sample, hold_only
from docloom.llm.ftrl import Ftrl, softmax
from docloom.llm.rules import MEASURES, SYMBOLS, measure_text

FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
PER_SIDE = 4000
EPOCHS = 2
ROUNDS = 50
GOOD, BAD, SILENT = 1, 0, 2
KEEP = 0.5
# A labeller sees at least this share of the bad documents it speaks on: bad documents are of many
# kinds, and without this floor one kind alone would be taken for all.
SEES = 0.35
# And it spares at least this share of the good ones.
SPARES = 0.99
REMEMBERED = 1 << 19
_LETTER = re.compile(rb"[a-z\x80-\xff]").search
_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS.encode()) + b"]").search
_SHARES = FEATURES + np.arange(4)
_words: dict[bytes, int] = {}

# Labeller, when it votes bad, when it votes good (bad is looked at first); the
# measures are those of the rule ledger and those of ``_more``.
LABELLERS = (
    ("length", lambda m: m["n_words"] < 5, lambda m: m["n_words"] >= 60),
    ("symbols", lambda m: m["n_symbols"] > 0.15 * m["n_words"], lambda m: m["n_symbols"] == 0),
    ("repeats", lambda m: m["n_repeat_words"] > 0.4 * m["n_words"], lambda m: m["n_repeat_words"] < 0.1 * m["n_words"]),
    ("lines", lambda m: m["n_dup_lines"] > 0.3 * m["n_lines"], lambda m: m["n_lines"] > 3 and m["n_dup_lines"] <= 1),
    ("letters", lambda m: m["worded"] < 0.8 * m["n_words"], lambda m: m["worded"] > 0.95 * m["n_words"]),
    ("variety", lambda m: m["n_distinct"] < 0.15 * m["n_words"], lambda m: m["n_distinct"] > 0.3 * m["n_words"]),
    ("ends", lambda m: m["n_ended"] == 0, lambda m: m["n_ended"] > 0.5 * m["n_lines"]),
    ("marks", lambda m: m["marked"] > 0.1 * m["n_words"], lambda m: m["marked"] == 0),
    ("width", lambda m: not 2.5 < m["mean"] < 9, lambda m: 3.5 < m["mean"] < 7),
)
PATTERNS = 3 ** len(LABELLERS)


def _forget() -> None:
    _words.clear()


def _measured(text: str | None) -> tuple[dict, dict[bytes, int]]:
    m = dict(zip(MEASURES, measure_text(text), strict=True))
    counted: dict[bytes, int] = {}
    for word in (text or "").lower().encode().split():
        counted[word] = counted.get(word, 0) + 1
    m["n_distinct"] = len(counted)
    m["worded"] = sum(n for word, n in counted.items() if _LETTER(word))
    signs = m["n_symbols"] > 0
    m["marked"] = sum(n for word, n in counted.items() if len(word) > 1 and _SYMBOL(word)) if signs else 0
    m["n_ended"] = sum(line.rstrip()[-1:] in ".!?" for line in (text or "").split("\n") if line.strip())
    m["mean"] = m["word_chars"] / max(1, m["n_words"])
    return m, counted


def votes(m: dict) -> list[int]:
    return [BAD if bad(m) else GOOD if good(m) else SILENT for _, bad, good in LABELLERS]


def code(given: list[int]) -> int:
    """A vote pattern as one number below ``PATTERNS``."""
    return sum(v * 3**k for k, v in enumerate(given))


def decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(codes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents, and how often each labeller is right on bad and on good ones.

    Expectation-maximisation over the counted patterns. It starts from the belief that most
    documents are good, that a labeller seldom blames one of those, and that it sees half of the
    bad ones.
    """
    given = decode(codes)
    prior, right = 0.8, np.tile([0.5, 0.995], (len(LABELLERS), 1))
    for _ in range(rounds if len(codes) else 0):
        p = posterior(given, prior, right)
        prior = float(np.clip((p @ n + 8) / (n.sum() + 10), 0.01, 0.99))
        for side, share in ((BAD, 1 - p), (GOOD, p)):
            weight = (share * n)[:, None]
            agree, spoken = (weight * (given == side)).sum(0), (weight * (given != SILENT)).sum(0)
            start = (0.5, 0.995)[side]
            right[:, side] = np.clip((agree + 10 * start) / (spoken + 10), (SEES, SPARES)[side], 0.999)
    return prior, right


def posterior(given: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    for_good = np.log(right[:, GOOD]) - np.log1p(-right[:, BAD])
    for_bad = np.log1p(-right[:, GOOD]) - np.log(right[:, BAD])
    odds = np.log(prior) - np.log1p(-prior) + ((given == GOOD) * for_good + (given == BAD) * for_bad).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _vector(m: dict, counted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with damped counts, of length one, and a bias."""
    if len(_words) > REMEMBERED:
        _words.clear()
    places = []
    for word in counted:
        at = _words.get(word)
        if at is None:
            at = _words[word] = xxhash.xxh32_intdigest(word) % (FEATURES - 1) + 1
        places.append(at)
    at, back = np.unique(np.array(places, np.int64), return_inverse=True)
    x = np.bincount(back, 1 + np.log(np.fromiter(counted.values(), float, len(counted))), len(at))
    # repetition, signs and shape of words are seen through three whole-text shares
    shares = np.array([1.0, m["n_repeat_words"] / max(1, m["n_words"]), min(2.0, m["n_symbols"] / max(1, m["n_words"])), 1 - m["worded"] / max(1, m["n_words"])])
    size = max(np.sqrt(x @ x), 1e-12)
    return np.concatenate([_SHARES, at]), np.concatenate([shares, x / size])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_only("quality", _forget)
    for batch in batches:
        codes = [code(votes(_measured(text)[0])) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "code"])


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``doc_id, code`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_patterns, "doc_id long, code long")


def fit(docs: DataFrame, voted: DataFrame, per_side: int = PER_SIDE) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Scorer weights, posterior of every pattern, share of good documents, labellers' accuracies."""
    counts = voted.groupBy("code").count().toPandas()  # at most PATTERNS rows
    codes, n = counts["code"].to_numpy(np.int64), counts["count"].to_numpy(np.float64)
    prior, right = estimate(codes, n)
    p = posterior(decode(np.arange(PATTERNS)), prior, right)
    spark = docs.sparkSession
    table = spark.createDataFrame([(int(c), float(p[c])) for c in codes], "code long, p double")
    leaning = voted.join(F.broadcast(table), "code").where("doc_id is not null and p <> 0.5")
    ranked = leaning.select("doc_id", "p", (F.col("p") > 0.5).alias("side"), hash60(F.col("doc_id"), "quality:").alias("h"))
    sample = hashed_sample(ranked, "side", per_side).select(F.col("doc_id").alias("k"), "p", "h")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, y, texts = (column.to_pylist() for column in batch.columns)
            made = [_vector(*_measured(text)) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h, pa.int64()),
                    pa.array(y, pa.float64()),
                    pa.array([at.astype("<i4").tobytes() for at, _ in made], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary()),
                ],
                ["h", "y", "at", "x"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = Ftrl(FEATURES + 4, 2)
        for _ in range(EPOCHS):
            for _, y, at, x in rows:
                model.learn(np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(float), np.array([1 - y, y]))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()], pa.binary())], ["weights"])

    # at most 2 * PER_SIDE ids are broadcast, and as many feature rows trained on in one task
    chosen = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("k")).select("h", "p", F.col("text").cast("string"))
    rows = chosen.mapInArrow(features, "h long, y double, at binary, x binary").repartition(1)
    found = rows.mapInArrow(train, "weights binary").first()
    weights = np.frombuffer(found["weights"]).reshape(-1, 2) if found else np.zeros((FEATURES + 4, 2))
    return weights, p, prior, right


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, n_votes, posterior, score, kept`` of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    voted = cut(vote_patterns(docs))
    weights, p, _, _ = fit(docs, voted)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only("quality", _forget)
        weights, p = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                m, counted = _measured(text)
                given = votes(m)
                at, x = _vector(m, counted)
                good = float(softmax(x @ weights[at])[1])
                rows.append((sum(v != SILENT for v in given), float(p[code(given)]), good, good >= KEEP))
            n, post, good, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(post, pa.float64()), pa.array(good, pa.float64()), pa.array(kept, pa.bool_())],
                ["doc_id", "n_votes", "posterior", "score", "kept"],
            )

    return docs.mapInArrow(run, "doc_id long, n_votes long, posterior double, score double, kept boolean")

"""Language identification: sparse softmax regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams (one to three characters) cover every learning document.
The weights are fitted by FTRL with elastic-net penalties on at most ``PER_LANGUAGE`` documents of
each language (those with the smallest id hash), a fifth of which only calibrate the temperature.
Prediction reads whole texts and nothing but texts.

The model is ``FEATURES`` x languages numbers; languages are the distinct values of ``lang`` in the
learning rows, a small vocabulary.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no
row can be learned from; repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc_mod, hash60, hashed_sample
from docloom.llm.ftrl import Ftrl, softmax, temperature

FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
PER_LANGUAGE = 1500
EPOCHS = 2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of a text: places and counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    shift = np.uint32(32 - FEATURE_BITS)
    grams = []
    total = np.zeros(len(points), np.uint32)
    for k in range(min(3, len(points))):
        total = (total[: len(points) - k] ^ (points[k:] + np.uint32(k))) * _FACTORS[k]
        grams.append((total ^ (total >> np.uint32(15))) * _FACTORS[0] >> shift)
    found = np.bincount(np.concatenate(grams).astype(np.int64), minlength=FEATURES) if grams else np.zeros(FEATURES, np.int64)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total[counts(text)[0]] += 1
            rows += 1
    at = np.append(np.flatnonzero(total), FEATURES)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total[at[:-1]], rows))], ["feature", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed idf of every feature over all rows of ``texts``; at most ``FEATURES`` + 1 sums reach the driver."""
    sums = texts.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    df = np.zeros(FEATURES + 1)
    df[found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1


def fit(learn: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, idf, weights and temperature from rows ``doc_id, text, lang`` (lang not null)."""
    spark = learn.sparkSession
    learn = learn.where("text is not null")
    hashed = learn.select("doc_id", "lang", hash60(F.col("doc_id"), "lang:").alias("h"))
    sample = hashed_sample(hashed, "lang", per_language).select(F.col("doc_id").alias("k"), "h").distinct()
    languages = [row[0] for row in learn.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return [], np.zeros(FEATURES), np.zeros((FEATURES, 0)), 1.0
    idf = inverse_frequencies(learn)
    shared = spark.sparkContext.broadcast((languages, idf))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf = shared.value
        for batch in batches:
            h, lang, texts = (column.to_pylist() for column in batch.columns)
            made = [vector(text, idf) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h, pa.int64()),
                    pa.array([languages.index(x) for x in lang], pa.int64()),
                    pa.array([at.astype("<i4").tobytes() for at, _ in made], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary()),
                ],
                ["h", "lang", "at", "x"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows = [(h, y, np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(float)) for h, y, at, x in rows]
        model, each = Ftrl(FEATURES, len(shared.value[0])), np.eye(len(shared.value[0]))
        for _ in range(EPOCHS):
            for h, y, at, x in rows:
                if h % 5:
                    model.learn(at, x, each[y])
        weights = model.weights()
        held = [(x @ weights[at], each[y]) for h, y, at, x in rows if not h % 5]
        t = temperature(np.array([a for a, _ in held]), np.array([b for _, b in held])) if held else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([t])], ["weights", "t"])

    # the sample is bounded by PER_LANGUAGE rows a language: a broadcast of ids, one training task
    chosen = learn.join(F.broadcast(sample), F.col("doc_id") == F.col("k")).select("h", "lang", "text")
    rows = chosen.mapInArrow(features, "h long, lang long, at binary, x binary").repartition(1)
    row = rows.mapInArrow(train, "weights binary, t double").first()
    return languages, idf, np.frombuffer(row["weights"]).reshape(FEATURES, len(languages)), row["t"]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, float]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf, weights, t = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                if not languages or not _LETTER.search(text or ""):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = vector(text, idf)
                p = softmax((x @ weights[at]) / t)
                names.append(languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; rows with crc32(doc_id) mod 4 = 2 are never learned from."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    learn = docs.where(~held & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    return predict(docs, fit(learn)).select("doc_id", held.alias("held_out"), "lang_pred", "score")

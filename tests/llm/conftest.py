"""Tables with every odd case that the operators must take: nulls, blanks, ties, long texts, clashing columns."""

import numpy as np
import pytest

# Names of helper columns inside operators, as columns of the input.
CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, part int, place long, shard int, slot long, "
    "h long, w string, n long, a long, p long, g long, size long, key string, row string, state int, count long, "
    "_at long, _bits int, _measures string"
)
EXTRA = (7, 1, 2, 3, 4, 5, "x", 6, 7, 8, 9, 10, "y", "z", 11, 12, 13, 14, "m")


def prose(seed, n=120, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


def odd_texts():
    base = prose(1)
    long = " ".join(f"x{k}" for k in np.random.default_rng(5).integers(0, 9000, 250_000))
    return [
        (1, base, "en", "b"),
        (2, base, "en", None),
        (3, base.replace("w5 ", "x ", 1) + " end", "fr", "a"),
        (4, None, None, "a"),
        (5, "", "en", "a"),
        (6, " \n\t ", "en", "c"),
        (7, "one two", "de", "a"),
        (8, "one two", "de", "a"),
        (8, "one two", "de", "a"),
        (None, prose(2), "en", "b"),
        (None, None, None, None),
        (9, "a " * 3000, "en", "b"),
        (10, "é 日本 語 ☃ <|endoftext|> \x1c ![] " + prose(3, 4000), "fr", "c"),
        (11, prose(4, 30), None, ""),
        (12, "The cat. the CAT, the\vcat\fthe cat;; sat\r\nthe cat " * 60, "en", "a"),
        (13, long + " " + " ".join(["over and over again we go"] * 2000), "en", "b"),
        (14, "\x00 a\x00b \x00", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(k, t, g, s, *EXTRA) for k, t, g, s in odd_texts()]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

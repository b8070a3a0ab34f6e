"""Token ids of texts against the library as it comes, added tokens included."""

import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def agree(texts, library):
    encode = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), public_tokenizers.PATTERN)
    plain = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode.encode(pa.array(texts, pa.string()))] == plain
    # a second time from memory, and one by one
    assert [x.tolist() for x in encode.encode(pa.array(texts, pa.string()))] == plain
    assert [encode.encode([t])[0].tolist() for t in texts[:200]] == plain[:200]


def test_added_tokens_are_one_id(library):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", "a <|endoftext|", "plain words only", None, "", "a  <|endoftext|>  b"]
    agree(texts, library)
    assert 50256 in library.encode(texts[0], add_special_tokens=False).ids


def test_every_short_text_of_odd_characters(library):
    letters = ["a", " ", "\n", "'", ".", "\0", "é", "7", "　", "\x1c"]
    agree(["".join(x) for n in (1, 2, 3) for x in itertools.product(letters, repeat=n)], library)


def test_random_texts(library):
    rng = np.random.default_rng(0)
    parts = ["word", "Wörter", "日本", "it's", "I'll", "x.y", "end.\nStart", "a\n\nb", "\t", "12", "☃", "...", "**", " ", "\n", "'s", " ", "\x85"]
    texts = [" ".join(rng.choice(parts, int(rng.integers(0, 30)))) + str(rng.choice(["", " ", "\n", "."])) for _ in range(800)]
    agree(texts, library)


def test_memory_is_given_up(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    agree([f"w{k} x{k}. y{k}\nz" for k in range(50)], library)

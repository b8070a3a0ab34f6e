"""A piece that the encoder remembers costs one look-up in a slice of texts."""

import pytest

from docloom.llm import tokens


class Counted(dict):
    looked = 0

    def get(self, *key):
        self.looked += 1
        return super().get(*key)

    def __contains__(self, key):
        self.looked += 1
        return super().__contains__(key)

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)


def test_known_pieces_are_looked_up_once():
    pytest.importorskip("public_tokenizers")
    encode = tokens.encoder(tokens.VOCABULARY)
    texts = [" ".join(["start", *(f"word{k}, {k % 50} naïve\nline" for k in range(300))])] * 2
    first = encode.encode(texts)
    encode.known = Counted(encode.known)
    again = encode.encode(texts)
    assert encode.known.looked <= len(set(texts[0].split(" ")))
    assert [x.tolist() for x in again] == [x.tolist() for x in first]
    assert [x.tolist() for x in first] == [x.ids for x in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]

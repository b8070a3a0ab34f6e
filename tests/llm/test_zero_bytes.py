"""Token ids of texts that hold NUL and other control characters."""

import itertools

from docloom.llm import tokens


def test_encoder_of_zero_bytes():
    encode = tokens.encoder(tokens.VOCABULARY)
    texts = ["a \0x b", "a \0. b", "a . b", "a \0 b", "a \0\0 b", "a x\0y, b", "\0", "\0a b", "a b\0", "a \0", "a \0it's b"]
    texts += ["a " + "".join(x) + " b" for n in (1, 2, 3, 4) for x in itertools.product("\0x.\x01", repeat=n)]
    plain = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encode.encode(texts)] == plain
    for fresh in (texts, texts[::-1]):
        tokens._forget()
        encode = tokens.encoder(tokens.VOCABULARY)
        assert [encode.encode([t])[0].tolist() for t in fresh] == [plain[texts.index(t)] for t in fresh]

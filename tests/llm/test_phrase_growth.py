"""What tasks of the collocations pass on grows no faster than the words that they read."""

import numpy as np
import pyarrow as pa
from test_phrase_memory import Frame

from docloom.llm import phrases, tries


def passed_on(n, words):
    """Rows given by one task of four for ``n`` random words, and the pairs in them."""
    trie = tries.build(np.concatenate([[0], np.ones(words, int)]), np.arange(words + 1).clip(1))
    ids = np.random.default_rng(n).integers(1, words + 1, n).astype(np.int32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"]), pa.array([n], pa.int64()), pa.array([ids.tobytes()], pa.binary())], schema=phrases._CODED
    )
    run = phrases.walk(Frame(), trie, {"en": int(trie.slot[1])}, 1, {"en": 4 * n}, 100, pairs=True)
    made = pa.Table.from_batches(list(run(iter([batch]))))
    if "counts" not in made.column_names:
        return len(made), len(made)
    met = {}
    for codes, counts in zip(made["codes"].to_pylist(), made["counts"].to_pylist(), strict=True):
        for code, k in zip(np.frombuffer(codes, np.int64).tolist(), np.frombuffer(counts, np.int64).tolist(), strict=True):
            assert code not in met  # no share has a pair of another
            met[code] = k
    # node 1 is the language, node k + 1 the word k
    first, second = ids[:-1].astype(np.int64) + 1, ids[1:].astype(np.int64) + 1
    expected = dict(zip(*(x.tolist() for x in np.unique(first * len(trie.slot) + second, return_counts=True)), strict=True))
    assert met == expected
    return len(made), len(met)


def test_pairs_follow_the_words():
    rows, pairs = passed_on(20_000, 300)
    more_rows, more_pairs = passed_on(100_000, 300)
    assert more_rows <= 5 * rows and more_pairs <= 5 * pairs

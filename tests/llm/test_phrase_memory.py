"""What a task of the collocations holds beside its Arrow batch does not follow the batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from docloom.llm import phrases, tries


def taken(run, batch):
    """Rows given by a task, and the most bytes that it held at a time."""
    tracemalloc.start()
    rows = sum(map(len, run(iter([batch]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most


class Frame:
    """A table whose ``mapInArrow`` gives the task's function."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_words_are_split_in_small_parts():
    rng = np.random.default_rng(7)
    words = np.array([f"word{k}" for k in range(3_000)])
    texts = [" ".join(words[row]) for row in rng.integers(0, len(words), (8_000, 250))]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    rows, most = taken(lambda batches: ([0] * len(x[3]) for b in batches for x in phrases._by_language(b)), batch)
    assert rows == 8_000 * 250
    assert most < 4 * batch.nbytes, f"{most >> 20} MB for {batch.nbytes >> 20} MB of text"


def test_numbered_texts_are_read_where_they_lie(monkeypatch):
    given = []
    monkeypatch.setattr(phrases, "give_back", lambda: given.append(1))
    trie = tries.build(np.array([0, 1, 1, 2]), np.array([1, 1, 2, 2]))
    ids = np.tile(np.array([1, 2, 0, 1], np.int32), 1 << 14)
    n = 400
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * n), pa.array([int((ids > 0).sum())] * n, pa.int64()), pa.array([ids.tobytes()] * n, pa.binary())],
        schema=phrases._CODED,
    )
    run = phrases.walk(Frame(), trie, {"en": int(trie.slot[1])}, 2, {"en": n * int((ids > 0).sum())}, 100, pairs=False)
    rows, most = taken(run, batch)
    assert given and rows
    assert most < batch.nbytes // 4, f"{most >> 20} MB for {batch.nbytes >> 20} MB of numbers"

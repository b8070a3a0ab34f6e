"""What a task of the n-gram Jaccard join holds beside its Arrow batch does not follow the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docloom.llm import jaccard


def test_sets_are_made_in_small_parts():
    words = np.array([f"word{k}" for k in range(3_000)])
    places = np.random.default_rng(7).integers(0, len(words), (4_096, 200))
    texts = [" ".join(words[row]) for row in places]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    given = sum(map(len, texts))
    tracemalloc.start()
    rows = [len(made) for made in jaccard._set_rows(5, 80)(iter([batch]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) >= len(texts) and max(rows) <= 4_096
    assert all(n <= 1_024 for n in rows[: len(texts) // 1_024])
    assert most < 8 * given, f"{most >> 20} MB for {given >> 20} MB of text"

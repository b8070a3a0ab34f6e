"""What a task that writes token ids holds beside its Arrow batch does not follow the batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import tokens


class Frame:
    """A table of (doc_id, text); ``mapInArrow`` runs the task and notes the most bytes that it held."""

    def __init__(self, batch):
        self.batch, self.rows, self.most = batch, 0, 0
        self.write = SimpleNamespace(options=lambda **_: self.write, parquet=lambda path: None)

    def select(self, *columns):
        return self

    repartitionByRange = sortWithinPartitions = select

    def mapInArrow(self, run, schema):
        run(iter([]))
        tracemalloc.start()
        self.rows = sum(sum(map(len, made.column("docs").to_pylist())) for made in run(iter([self.batch])))
        self.most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return self


def test_texts_are_encoded_in_small_parts(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    given = []
    monkeypatch.setattr(tokens, "give_back", lambda: given.append(1))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    words = np.array([f"word{k}" for k in range(3_000)])
    places = np.random.default_rng(7).integers(0, len(words), (4_096, 300))
    texts = [" ".join(words[row]) for row in places]
    docs = Frame(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]))
    tokens.write_ids(docs, "nowhere")
    assert docs.rows == len(texts) and given
    assert docs.most < 8 * docs.batch.nbytes, f"{docs.most >> 20} MB for {docs.batch.nbytes >> 20} MB of text"

"""Words of a column of texts as arrays: no Python object per word.

``split`` works on the bytes of an Arrow column at once. A word is a run of word bytes of one text;
``spaces`` end a word, ``stops`` end a word and the piece it stands in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

ASCII_SPACES = b" \t\n\x0b\x0c\r"
# Bytes of text taken together; a longer text is a slice of its own.
SLICE_BYTES = 6 << 20


@dataclass(frozen=True)
class Words:
    """``words`` in order; text ``d`` has those from ``first[d]`` to ``first[d + 1]``; equal ``piece`` = same piece."""

    words: pa.BinaryArray
    first: np.ndarray
    piece: np.ndarray


def _classes(spaces: bytes, stops: bytes) -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[list(spaces)] = 1
    kind[list(stops)] = 2
    return kind


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lowered()


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text; a longer text is a range of its own."""
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(bounds, bounds[low] + size, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high
        low = high


def split(column: pa.Array, spaces: bytes = ASCII_SPACES, stops: bytes = b"", lower: bool = False) -> Words:
    """The words of a string or binary column; a null text has none. ``lower`` changes A-Z only."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    low, high = int(bounds[0]), int(bounds[-1])
    bounds = bounds - low
    if high == low:
        return Words(pa.array([], pa.binary()), np.zeros(len(column) + 1, np.int64), np.empty(0, np.int64))
    data = np.frombuffer(column.buffers()[2], np.uint8)[low:high]
    if lower:
        data = _LOWER[data]
    kind = _classes(spaces, stops)[data]
    inside = kind == 0
    # a text's first byte follows nothing, its last is followed by nothing
    follows = np.empty(len(data) + 1, bool)
    follows[0] = False
    follows[1:] = inside
    follows[bounds] = False
    starts = np.flatnonzero(inside & ~follows[:-1])
    follows[1:] = inside
    follows[0] = False
    continued = follows[1:].copy()
    continued[:-1] = inside[1:]
    continued[-1] = False
    edges = bounds[1:] - 1
    continued[edges[edges >= 0]] = False
    ends = np.flatnonzero(inside & ~continued) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.BinaryArray.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    )
    first = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    piece = text if not stops else np.cumsum(kind == 2)[starts] + text
    return Words(words, first, piece)

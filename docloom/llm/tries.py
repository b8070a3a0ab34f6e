"""Tries over whole-number symbols as hash tables, made and walked by numpy at many places at once.

The state of a node is its number and one; no node is state ``DEAD``. A table of at least twice as many
places as nodes holds every node's state under its parent's state and its symbol, at the first free place
from that key's hash on. Making it takes time in proportion to the nodes, whatever their shape. Symbols
count from 1; symbol 0 leads nowhere.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

DEAD, ROOT = 0, 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Trie(NamedTuple):
    # state of the parent times the number of symbols, and the symbol (-1: free), with the child's state
    key: np.ndarray
    child: np.ndarray
    symbols: np.ndarray
    # node number of every state (-1: none) and state of every node; node 0 is the root
    node: np.ndarray
    slot: np.ndarray


def _places(key: np.ndarray, size: int) -> np.ndarray:
    """Where to look first; ``size`` is a power of two."""
    return (key.astype(np.uint64) * _FACTOR >> np.uint64(65 - size.bit_length())).astype(np.int64)


def step(trie: Trie, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The states reached from ``states`` by ``symbols``, all at once."""
    wide, size = int(trie.symbols[0]), len(trie.key)
    out = np.zeros(len(states), np.int32)
    live = np.flatnonzero((states > DEAD) & (symbols > 0) & (symbols < wide))
    key = states[live].astype(np.int64) * wide + symbols[live]
    at = _places(key, size)
    while len(live):
        held = trie.key[at]
        hit = held == key
        out[live[hit]] = trie.child[at[hit]]
        on = np.flatnonzero(~hit & (held >= 0))
        live, key, at = live[on], key[on], (at[on] + 1) & (size - 1)
    return out


def build(parent: np.ndarray, symbol: np.ndarray) -> Trie:
    """The trie of nodes 1, 2, ...: node ``k + 1`` hangs below node ``parent[k]`` by ``symbol[k]``."""
    n = len(parent) + 1
    wide = int(symbol.max(initial=0)) + 1
    size = 1 << max(3, (2 * n - 1).bit_length())
    own = (parent.astype(np.int64) + 1) * wide + symbol
    key, child = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    left, at = np.arange(n - 1), _places(own, size)
    while len(left):
        free = key[at] < 0
        key[at[free]] = own[left[free]]
        # of several at one free place, the last one got it
        done = free & (key[at] == own[left])
        child[at[done]] = left[done] + 2
        left, at = left[~done], (at[~done] + 1) & (size - 1)
    node = np.arange(-1, n, dtype=np.int32)
    return Trie(key, child, np.array([wide]), node, np.arange(1, n + 1, dtype=np.int32))

"""Making a trie takes time in proportion to its nodes, also where many nodes share their children's symbols."""

import time

import numpy as np

from docloom.llm import tries


def made(words, parents, children):
    """Seconds of making a trie of ``words`` words, ``parents`` of which are followed by common words; the trie."""
    rng = np.random.default_rng(parents)
    common = np.sort(rng.permuted(np.tile(np.arange(1, 4 * children + 1), (parents, 1)), axis=1)[:, :children], axis=1)
    parent = np.concatenate([np.zeros(words, int), np.repeat(np.arange(1, parents + 1), children)])
    symbol = np.concatenate([np.arange(1, words + 1), common.ravel()])
    began = time.process_time()
    trie = tries.build(parent, symbol)
    took = time.process_time() - began
    states = tries.step(trie, trie.slot[parent], symbol)
    assert (trie.node[states] == np.arange(1, len(parent) + 1)).all()
    absent = tries.step(trie, trie.slot[parent[words:]], symbol[words:] + 4 * children)
    assert (absent == tries.DEAD).all()
    return took


def test_a_trie_is_made_in_linear_time():
    assert made(20_000, 10_000, 24) < 1

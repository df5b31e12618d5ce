"""Hashes of words and of runs of words.

A word's hash is 64 bits of xxh3 over its bytes. A run's hash takes up its words one by one, each mixed with the hash so far, in
numpy for all runs at once, so it depends on every word and on their order. Equal runs have equal hashes wherever they stand.

Words in an array of bytes have other hashes (`hashes_at`): up to 32 bytes are taken up in numpy for all words at once, by length
and blocks of 8 bytes, each mixed with the hash so far.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes], width: int = 1) -> np.ndarray:
    """Hashes of all runs of `width` words, in order."""
    one = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    runs = max(0, len(words) - width + 1)
    h = mix(one[:runs] + np.uint64(width))
    for k in range(1, width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + one[k : k + runs])
    return h


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the words that are hashed by blocks; longer ones, which are few, go by xxh3 each. Of a block, the bytes that a word has.
SHORT = 32
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hashes_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words that stand in these bytes, after which there must be 8 more."""
    blocks = np.lib.stride_tricks.sliding_window_view(data, 8).view("<u8")[:, 0]
    found = mix(mix(blocks[starts] & _BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _STEP)
    for k in range(8, SHORT, 8):
        at = np.flatnonzero(lengths > k)
        found[at] = mix(found[at] * _STEP + (blocks[starts[at] + k] & _BYTES[np.minimum(lengths[at] - k, 8)]))
    for i in np.flatnonzero(lengths > SHORT):
        found[i] = xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return found


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; fewer words are one run; no words, none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(word_hashes(words, min(width, len(words))))

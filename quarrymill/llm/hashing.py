"""Words of Arrow text arrays as strong hashes, and hashes of runs of words, in numpy.

A word of at most ``SHORT`` bytes is its bytes and length, 128 bits, sent through a Feistel
network: a bijection, so no two such words have one hash.  A longer word is hashed by keyed
BLAKE2b.  Runs of words are hashed by doubling: the hash of a run is a mix of the hashes of
its two halves (which overlap where the width is no power of two), never a sum, so no
arrangement of words cancels out.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: The longest word that fits 128 bits with its length.
SHORT = 15
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_ADD = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_digest = partial(hashlib.blake2b, digest_size=16, key=b"words of a text")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bits of the first and the last eight bytes that a word of each length has.
_MASKS = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(SHORT + 1)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of the splitmix kind: a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[bytes, list[int]]]:
    """Two halves of each word of a binary array (nulls: none), the row cuts, and the places
    of the words too long for them (whose halves say nothing)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64), {}
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0])
    data = np.zeros(n + SHORT + 1, dtype=np.uint8)
    if n:
        data[:n] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    if lower:
        data = _LOWER[data]
    rows = offsets - offsets[0]
    full = ~_BLANK[data[:n]]
    edge = np.zeros(n + 1, dtype=bool)
    edge[rows] = True
    starts = np.flatnonzero(full & (edge[:n] | ~np.concatenate(([False], full[:-1]))[:n]))
    ends = np.flatnonzero(full & (edge[1:] | ~np.concatenate((full[1:], [False]))[:n])) + 1
    size = ends - starts
    eight = np.lib.stride_tricks.sliding_window_view(data, SHORT + 1)[starts].view("<u8")
    mask = _MASKS[np.minimum(size, SHORT)]
    low, high = eight[:, 0] & mask[:, 0], (eight[:, 1] & mask[:, 1]) | (np.minimum(size, SHORT + 1).astype(np.uint64) << np.uint64(56))
    long: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(size > SHORT).tolist():
        long.setdefault(data[starts[i] : ends[i]].tobytes(), []).append(i)
    return low, high, np.searchsorted(starts, rows), long


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a binary array as a pair of lanes (2 x words), and the row cuts."""
    low, high, cuts, long = _words(texts, lower)
    for odd, add in zip(_ODD, _ADD, strict=True):
        low = low + mixed(high * odd ^ add)
        high = high + mixed(low * odd + add)
    for word, places in long.items():
        digest = np.frombuffer(_digest(word).digest(), dtype="<u8")
        low[places], high[places] = digest
    return np.stack([low, high]), cuts


def word_numbers(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, equal within this call exactly where the words are, and the row cuts."""
    low, high, cuts, long = _words(texts, lower)
    for k, places in enumerate(long.values()):
        low[places], high[places] = k, np.uint64((SHORT + 1) << 56)
    return numbered(numbered(low), numbered(high)), cuts


def numbered(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Small numbers in place of values, or of pairs of small numbers."""
    return pd.factorize(first if second is None else first * np.int64(second.max(initial=0) + 1) + second)[0]


def run_hashes(words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one lane, also across rows."""
    if words.size < width:
        return np.zeros(0, dtype=np.uint64)
    out, span = words, 1
    while span < width:
        step = min(span, width - span)
        out = mixed(out[:-step] * _ODD[lane] + mixed(out[step:] ^ _ADD[lane]))
        span += step
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n, out, span = values.size - width + 1, values, 1
    if n <= 0:
        return values[:0]
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]

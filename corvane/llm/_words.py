"""Words and word shingles of many texts at once, as 64-bit hashes, with numpy.

A word is a maximal run of signs other than ``[\\x20\\x09-\\x0D]``; A-Z are
lower-cased.  A word's hash mixes its UTF-8 bytes eight at a time, each time through a
whole avalanche, so that no pattern of bytes cancels out (a sum of powers would do that);
words of over ``LONG`` bytes take xxh3.  Shingle hashes chain the hashes of their words.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 128
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: The lowest n bytes of a lane.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words (n+1 offsets)."""
    coded = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(coded) + b"\n" + bytes(8), np.uint8)]
    size = len(data) - 8
    word = ~_BLANK[data[:size]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    lanes = np.lib.stride_tricks.as_strided(data.view(np.uint8)[: 8].view("<u8"), shape=(size + 1,), strides=(1,))
    left = hi - lo
    hashes = mix(left.astype(np.uint64) * _C2 + np.uint64(seed) * _C1 + _BASE)
    some, at = np.flatnonzero(left <= LONG), lo[left <= LONG]
    rest = left[some]
    while len(some):
        lane = lanes[at] & _MASK[np.minimum(rest, 8)]
        hashes[some] = mix((hashes[some] ^ lane) * _BASE + _C1)
        more = rest > 8
        some, at, rest = some[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(left > LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[lo[k] : hi[k]].tobytes(), seed)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    starts = np.cumsum(sizes) - sizes
    return hashes, np.append(np.searchsorted(lo, starts), len(lo))


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words; window i begins at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out * _BASE + hashes[k : k + n])
    return out


def shingle_sets(texts: list[str | None], width: int = 5, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width``: one
    shingle of all words; no words: empty."""
    words, bounds = word_hashes(texts, seed)
    all_windows = chain(words, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(all_windows[a : b - width + 1]))
        elif b > a:
            out.append(mix(chain(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

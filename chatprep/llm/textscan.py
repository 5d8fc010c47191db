"""Words and other short spans of UTF-8 text, found and keyed with numpy.

All functions work on one byte array that holds many documents, with the borders of the
documents, so that their cost per byte does not depend on how long the documents are.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHORT = 64  # longer spans get the key of a byte hash
CHUNK = 1 << 17
_BASE = 0x9E6C63D0876A9A47
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + SHORT, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))

# Bytes of words: digits, letters, everything beyond ASCII.  A-Z are lowered first.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
# Bytes of words that only space characters end.
BLACK = np.ones(256, bool)
BLACK[[9, 10, 11, 12, 13, 32]] = False


def words(data: np.ndarray, borders: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which ``inside`` holds, per document."""
    hold = inside[data]
    if not len(hold):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(hold)
    before[0] = False
    before[1:] = hold[:-1]
    cuts = borders[1:-1]
    cuts = cuts[cuts < len(hold)]
    before[cuts] = False
    after = np.empty_like(hold)
    after[-1] = False
    after[:-1] = hold[1:]
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(hold & ~before), np.flatnonzero(hold & ~after) + 1


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span's bytes; ``starts`` ascend.

    Spans of at most 64 bytes are keyed by a polynomial over their bytes, read off running
    sums; longer ones by XXH3.  Equal spans have equal keys at any place in any task.
    """
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    for low in range(0, len(data), CHUNK):
        first, last = np.searchsorted(starts, (low, low + CHUNK))
        if first == last:
            continue
        part = data[low : low + CHUNK + SHORT]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], out=sums[1:])
        a = starts[first:last] - low
        b = np.minimum(ends[first:last] - low, len(part))
        out[first:last] = (sums[b] - sums[a]) * _INVERSE[a]
    out += sizes.astype(np.uint64) * _MIX
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def per_document(starts: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Borders of the spans by document: document i has spans ``out[i]`` to ``out[i + 1]``."""
    out = np.searchsorted(starts, borders)
    out[-1] = len(starts)
    return out

"""Simple-8b words: a 4-bit selector and 60 bits of payload, encoded and decoded with numpy.

Ids are cut into blocks of 128 that stand alone; the word at which each block starts is kept
beside the words, so that any block can be decoded by itself and all of them side by side.

Selector 0 is an escape: the next word is one raw 64-bit value.  The others say how many values
of how many bits the word holds; in the last word of a block fewer may be left.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
PART = BLOCK << 9  # ids worked on at once
# Values and bits per word, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LIMITS = np.uint64(1) << BITS[1:].astype(np.uint64)  # a value fits selector s when below _LIMITS[s - 1]
_NEED = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def _needs(values: np.ndarray) -> np.ndarray:
    """For each value, the smallest s for which selector s + 1 holds it; 15 for none."""
    out = _NEED[(values & np.uint64(0xFFFF)).astype(np.uint16)]
    large = np.flatnonzero(values >> np.uint64(16))
    out[large] = np.searchsorted(_LIMITS, values[large], "right")
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64), and the number of the first word of each block (int64, with the end)."""
    parts = [_encode(values[i : i + PART]) for i in range(0, len(values), PART)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ends = np.cumsum([len(w) for w, _ in parts])
    starts = [s[:-1] + end - len(w) for (w, s), end in zip(parts, ends, strict=True)]
    return np.concatenate([w for w, _ in parts]), np.concatenate([*starts, ends[-1:]])


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    blocks = -(-n // BLOCK)
    flat = np.zeros(blocks * BLOCK + 128, np.uint64)
    flat[:n] = values
    need = _needs(flat[: blocks * BLOCK]).reshape(blocks, BLOCK)

    # Widest need among the next values of the block, for growing numbers of them; the most
    # values that fit win.  Beyond the end of a block nothing is needed.
    best = np.zeros((blocks, BLOCK), np.uint8)
    widest, width = need, 1
    for selector in range(15, 0, -1):
        while width < COUNTS[selector]:
            step = min(width, COUNTS[selector] - width)
            grown = widest.copy()
            np.maximum(widest[:, :-step], widest[:, step:], out=grown[:, :-step])
            widest, width = grown, width + step
        fits = widest <= selector - 1
        if not fits.any():
            break
        best[fits] = selector

    # All blocks step from word to word side by side.
    best, origin = best.ravel(), np.arange(blocks) * BLOCK
    stop = np.minimum(origin + BLOCK, n)
    place = np.full((blocks, BLOCK), -1, np.int64)
    at, rows, steps = origin.copy(), np.arange(blocks), 0
    while len(rows):
        here = at[rows]
        place[rows, steps] = here
        here += COUNTS[best[here]]
        at[rows] = here
        rows, steps = rows[here < stop[rows]], steps + 1
    place = place[:, :steps]
    used = place >= 0
    place, per_block = place[used], used.sum(1)

    selector = best[place]
    escape = selector == 0
    first = np.arange(len(place)) + np.cumsum(escape) - escape
    words = np.zeros(len(place) + int(escape.sum()), np.uint64)
    words[first] = selector.astype(np.uint64) << np.uint64(60)
    words[first[escape] + 1] = flat[place[escape]]
    inside = np.repeat(stop, per_block) - place  # values that are left in the block
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        made, ids, left = words[first[mine]], place[mine], inside[mine]
        for j in range(COUNTS[s]):
            value = flat[ids + j] << np.uint64(BITS[s] * j)
            made |= value if left.min() > j else np.where(left > j, value, np.uint64(0))
        words[first[mine]] = made
    return words, np.append(first, len(words))[np.concatenate([[0], np.cumsum(per_block)])]


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values (uint64) of whole blocks; ``starts`` as ``encode`` gave them."""
    step, out = PART // BLOCK, []
    for i in range(0, len(starts) - 1, step):
        part = starts[i : i + step + 1]
        out.append(_decode(words[part[0] : part[-1]], part - part[0], min(PART, n - i * BLOCK)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # In a run of words that look like escapes every second one is raw, and so is the word
    # after a run of odd length.
    zero = selector == 0
    index = np.arange(len(words))
    run = index - np.maximum.accumulate(np.where(zero, -1, index))  # how many zeros up to here
    raw = np.zeros(len(words), bool)
    raw[1:] = zero[:-1] & (run[:-1] % 2 == 1)
    block = np.searchsorted(starts, index, "right") - 1
    held = np.where(raw, 0, COUNTS[selector])
    before = np.cumsum(held) - held
    before -= before[starts[:-1]][block]
    left = np.minimum(n - block * BLOCK, BLOCK) - before
    base = block * BLOCK + before
    escapes = np.flatnonzero(zero & ~raw)
    out[base[escapes]] = words[escapes + 1]
    for s in range(2, 16):
        mine = np.flatnonzero((selector == s) & ~raw)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        if not len(mine):
            continue
        held, to, few = words[mine], base[mine], left[mine]
        for j in range(COUNTS[s]):
            if few.min() <= j:
                held, to, few = held[few > j], to[few > j], few[few > j]
                if not len(few):
                    break
            out[to + j] = held >> np.uint64(BITS[s] * j) & mask
    return out

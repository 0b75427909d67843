"""Blocks of equal-length byte windows, placed by the content.

Every ``length``-byte window takes as its anchor the leftmost smallest hash of
its ``GRAM``-byte substrings, so equal windows have their anchor at the same
place.  Windows of a text with the same anchor, whose starts lie in one stretch
of ``STRETCH`` bytes counted back from it, form a block.  All windows of a
stretch hold its *core* (the bytes common to them); the block's *hull* are the
bytes of all its windows.  Two windows can only be equal if their blocks' cores
are equal; if two blocks' hulls are equal, all their windows are.
"""

from __future__ import annotations

import numpy as np

from sparselm.llm.textblock import RangeHasher

GRAM = 64
STRETCH = 128
_PLACE_BITS = 30


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def window_blocks(data: np.ndarray, off: np.ndarray, length: int, hasher: RangeHasher):
    """(text, ref, first, last, core hash, hull hash) of every block; starts of
    its windows are ref - first .. ref - last, first >= last."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    if n >= 1 << _PLACE_BITS:
        raise ValueError("a text slice of 1 GiB or more")
    grams = hasher.windows(GRAM)
    grams >>= np.uint64(_PLACE_BITS)
    grams <<= np.uint64(_PLACE_BITS)
    grams |= np.arange(len(grams), dtype=np.uint64)
    low = _sliding_min(grams, length - GRAM + 1)
    anchor = (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    inside = np.zeros(n + 1, dtype=np.int32)     # starts whose window stays in its text
    ends = np.maximum(off[1:] - length + 1, off[:-1])
    np.add.at(inside, off[:-1], 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:len(anchor)]) > 0
    start, anchor = start[inside], anchor[inside]
    stretch = (anchor - start) // STRETCH
    ref = anchor - stretch * STRETCH
    new = np.ones(len(start), dtype=bool)
    # the next anchor, at the far end of its window, may give the same ref
    new[1:] = ((ref[1:] != ref[:-1]) | (stretch[1:] != stretch[:-1])
               | (start[1:] != start[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(start)] - 1
    ref, first, last = ref[head], start[head], start[tail]
    stretch = stretch[head]
    core = hasher(ref, ref - STRETCH + 1 + length) + stretch.astype(np.uint64)
    hull = hasher(first, last + length) + ((ref - first) * STRETCH + (ref - last)).astype(np.uint64)
    text = np.searchsorted(off, first, side="right") - 1
    return text, ref, ref - first, ref - last, core, hull

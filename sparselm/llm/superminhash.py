"""SuperMinHash signatures, vectorised over the elements of many sets.

For an element d and signature length m let p(d, .) be a random permutation of
the slots and r(d, i) a random fraction.  At level i the element offers
``i + r(d, i)`` to slot ``p(d, i)``; slot values are the minimum over the set.
Ranks within one element are thus correlated (a permutation), which lowers the
variance below MinHash's, and a set is finished early: once all its slots hold
a value of a level <= i, later levels cannot change it.
"""

from __future__ import annotations

import numpy as np

from sparselm.llm.textblock import mix

_FRACTION_BITS = 24
_EMPTY = np.uint32(0xFFFFFFFF)
_LEVEL = 0xD1342543DE82EF95


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m uint32 signatures of the sets given as (element hash, set
    index), sorted by set.  A set without elements keeps the empty value."""
    sig = np.full(n_docs * m, _EMPTY, dtype=np.uint32)
    active_h, active_d = h, doc
    perm = None
    j0 = None
    for level in range(m):
        if len(active_h) == 0:
            break
        x = mix(active_h + np.uint64((level + 1) * _LEVEL & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint32(level) << np.uint32(_FRACTION_BITS)) | \
            (x >> np.uint64(64 - _FRACTION_BITS)).astype(np.uint32)
        pick = level + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - level)
                        >> np.uint64(32)).astype(np.int64)
        # Fisher-Yates, the state only written out from level 2 on
        if level == 0:
            slot = j0 = pick
        elif level == 1:
            slot = np.where(pick == j0, 0, pick)
            j1 = pick
        else:
            rows = np.arange(len(active_h))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(active_h), 1))
                for i, j in ((0, j0), (1, j1)):
                    a, b = perm[rows, i].copy(), perm[rows, j].copy()
                    perm[rows, i], perm[rows, j] = b, a
            a, b = perm[rows, level].copy(), perm[rows, pick].copy()
            perm[rows, level], perm[rows, pick] = b, a
            slot = b.astype(np.int64)
        np.minimum.at(sig, active_d * m + slot, value)
        # sets with a slot that is empty may still change
        top = sig.reshape(n_docs, m).max(axis=1)
        open_set = (top >> np.uint32(_FRACTION_BITS)) > level
        stay = open_set[active_d]
        active_h, active_d = active_h[stay], active_d[stay]
        if level == 0:
            j0 = j0[stay]
        elif level == 1:
            j0, j1 = j0[stay], j1[stay]
        else:
            perm = perm[stay]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots; the band is part of it."""
    n, m = sig.shape
    bands = m // rows
    out = np.zeros((n, bands), dtype=np.uint64)
    for b in range(bands):
        k = np.full(n, b + 1, dtype=np.uint64)
        for j in range(rows):
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + j])
        out[:, b] = k
    return out

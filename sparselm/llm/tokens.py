"""Token ids of whole texts in Spark tasks, with a bounded cache.

A byte-level BPE splits a text into pieces before merging.  A single space or
line feed between two characters that are not white space always starts a
piece, and so does a punctuation mark behind a letter or digit.  Texts are cut
there, every distinct unit is encoded by the tokenizer itself, and the
ids of a text are the concatenation of its units' ids.  Units are looked up by
64-bit fingerprint in arrays that live as long as the worker; they are bounded,
and emptied when full.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from sparselm.llm import textblock

CACHE_UNITS = 2_000_000     # some 90 MB
_LONG_UNIT = 64             # longer units are encoded anew each time

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, dtype=bool)     # ASCII letters and digits
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, dtype=bool)       # ASCII marks, but for the bar of special tokens
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E]] = True
_WIDE = np.zeros(256, dtype=bool)
_WIDE[0xE1:0xE4] = True     # lead bytes of the wide white space characters


def default_tokenizer() -> str:
    """Path of the tokenizer file; ``SPARSELM_TOKENIZER`` overrides it."""
    path = os.environ.get("SPARSELM_TOKENIZER")
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte starts of all units of a block: the starts of its texts that are
    not empty, and places where a piece surely starts (not to cut is always
    right)."""
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < n - 1)]
    if len(at):
        before, after = data[at - 1], data[at + 1]
        ok = ~_SPACE[before] & ~_SPACE[after] & ~_WIDE[after]
        # NEL and the no-break space are C2 85 and C2 A0
        ok &= ~((after == 0xC2) & np.isin(data[np.minimum(at + 2, n - 1)], (0x85, 0xA0)))
        ok &= ~((data[np.maximum(at - 2, 0)] == 0xC2) & np.isin(before, (0x85, 0xA0)))
        ok &= ~((before >= 0x80) & _WIDE[data[np.maximum(at - 3, 0)]])
        at = at[ok]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        at = at[~edge[at] & ~edge[at + 1]]              # both neighbours in the text
        begins[at] = True
    mark = np.flatnonzero(_MARK[data])
    mark = mark[mark > 1]
    if len(mark):
        before = data[mark - 1]
        ok = _LETTER[before]
        # letters of Latin-1: C3 80 to C3 BF without the times and division signs
        ok |= (data[mark - 2] == 0xC3) & (before >= 0x80) & ~np.isin(before, (0x97, 0xB7))
        begins[mark[ok]] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._limit = cache_units
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)            # sorted fingerprints
        self._start = np.zeros(0, np.int64)             # into the pool
        self._size = np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint32)

    def _encode(self, units: list[str]):
        """(ids of all units, size of each)."""
        sizes, ids = [], array("I")
        for lo in range(0, len(units), 20_000):
            for e in self._tok.encode_batch_fast(units[lo:lo + 20_000],
                                                 add_special_tokens=False):
                x = e.ids
                sizes.append(len(x))
                ids.extend(x)
        return np.frombuffer(ids, dtype=np.uint32), np.array(sizes, dtype=np.int64)

    def encode(self, texts: pa.Array, with_ids: bool = True):
        """(ids, offsets): ids[offsets[i]:offsets[i + 1]] are those of text i;
        null counts as empty.  Without ``with_ids`` the ids are None."""
        data, off = textblock.block(texts, lower=False)
        start = unit_starts(data, off)
        n = len(off) - 1
        if len(start) == 0:
            return (np.zeros(0, np.uint32) if with_ids else None), np.zeros(n + 1, np.int64)
        end = np.r_[start[1:], len(data)]
        word, first, inverse = np.unique(textblock.RangeHasher(data)(start, end),
                                         return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, word)
        if len(self._known):
            new = self._known[np.minimum(at, len(self._known) - 1)] != word
        else:
            new = np.ones(len(word), dtype=bool)
        if new.any():
            raw = data.tobytes()
            ask = first[new]
            ids, size = self._encode([raw[s:e].decode() for s, e in
                                      zip(start[ask].tolist(), end[ask].tolist())])
            place = np.cumsum(size) - size + len(self._pool)
            self._pool = np.concatenate([self._pool, ids])
            spot = at[new]
            self._known = np.insert(self._known, spot, word[new])
            self._start = np.insert(self._start, spot, place)
            self._size = np.insert(self._size, spot, size)
            at = np.searchsorted(self._known, word)
        where, size = self._start[at][inverse], self._size[at][inverse]
        # units belong to the text that holds their first byte
        edge = np.searchsorted(start, off)
        total = np.r_[0, np.cumsum(size)]
        out = None
        if with_ids:
            out = self._pool[np.repeat(where - total[:-1], size) + np.arange(total[-1])]
        if len(self._known) > self._limit or len(self._pool) > 16 * self._limit:
            self._forget()
        elif new.any() and (long := (end - start)[first[new]] > _LONG_UNIT).any():
            keep = ~np.isin(self._known, word[new][long])
            self._known, self._start, self._size = (
                self._known[keep], self._start[keep], self._size[keep])
        return out, total[edge]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

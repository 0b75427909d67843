"""Numpy kernels over one Arrow batch of texts.

A *block* is the concatenated UTF-8 of the texts of a batch with the byte
offset of every text.  All functions work on whole texts; a null text counts
as empty.  Word and shingle identities are 64-bit hashes: a random value per
byte, weighted by powers of an odd number, so that the hash of any byte range
comes from one running sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C13)            # = 3 mod 8
_M64 = (1 << 64) - 1
ODD_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SLICE_BYTES = 2 << 20
IS_WORD_BYTE = ~_SPACE                          # words [^\x20\x09-\x0D]+


def text_slices(batch: pa.RecordBatch, column: str, size_bytes: int = SLICE_BYTES):
    """Slices of a batch of about ``size_bytes`` of text (null counts as empty),
    longer by at most one text."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // size_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def array_slices(texts: pa.Array):
    """:func:`text_slices` of a single column."""
    for b in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        yield b.column(0)


def block(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    # only this slice's bytes: the buffer behind it holds the whole batch
    raw = b"" if data is None else data.slice(off[0], off[-1] - off[0]).to_pybytes()
    if lower:
        raw = raw.translate(LOWER)
    return np.frombuffer(raw, dtype=np.uint8), off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class RangeHasher:
    """Hash of any byte range of a block from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        up = _powers(ODD, n)
        up *= BYTE_VALUES[data]
        np.cumsum(up, out=self.sums[1:])
        self.down = _powers(ODD_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.down[start]
        return mix(h ^ (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k-byte window (by start)."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.down[:len(h)]
        return mix(h)


def word_bounds(data: np.ndarray, off: np.ndarray,
                is_word: np.ndarray = IS_WORD_BYTE):
    """(start, end, text index) of every word; words never cross texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    first = np.zeros(n + 1, dtype=bool)         # a text begins here
    first[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = w[:-1]
    before[first[:n]] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[first[1:]] = False
    end = np.flatnonzero(w & ~after) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return start, end, doc


def word_hashes(data, off, is_word=IS_WORD_BYTE):
    """(hash, text index) of every word, in order."""
    start, end, doc = word_bounds(data, off, is_word)
    if len(start) == 0:
        return np.zeros(0, np.uint64), doc
    return RangeHasher(data)(start, end), doc


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5):
    """(hash, text index) of the distinct k-word shingles of every text, sorted
    by text and hash; a text of fewer words, but not none, gives its whole
    word sequence as one shingle."""
    n_words = np.bincount(doc, minlength=n_docs)
    parts_h, parts_d = [], []
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            h *= ODD
            h += words[j:len(words) - k + 1 + j]
        ok = doc[k - 1:] == doc[:len(doc) - k + 1]
        parts_h.append(mix(h[ok]))
        parts_d.append(doc[:len(h)][ok])
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.searchsorted(doc, short)
        h = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            more = n_words[short] > j
            at = np.minimum(first + j, len(words) - 1)
            h = np.where(more, h * ODD + words[at], h)
        parts_h.append(mix(h ^ (n_words[short].astype(np.uint64) << np.uint64(56))))
        parts_d.append(short)
    if not parts_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]

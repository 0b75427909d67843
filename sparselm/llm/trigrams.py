"""Boolean trigram queries from regular expressions, and a trigram inverted
index over one batch of texts.

A query is ``None`` (any text may match), a trigram, or a tuple
``("and" | "or", (query, ...))``.  It holds in every text that the expression
matches; letters are compared in lower case, so it serves case-insensitive
rules too.
"""

from __future__ import annotations

import re

import numpy as np

_MAX_EXACT = 16             # alternatives kept as whole strings


def _all_of(*queries):
    parts = []
    for q in queries:
        if q is None:
            continue
        parts.extend(q[1] if isinstance(q, tuple) and q[0] == "and" else [q])
    parts = list(dict.fromkeys(parts))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(*queries):
    if any(q is None for q in queries):
        return None
    parts = list(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _string(s: str):
    data = s.lower().encode()
    return _all_of(*(data[i:i + 3] for i in range(len(data) - 2)))


def _strings(exact):
    return _any_of(*(_string(s) for s in exact)) if exact else None


class _Info:
    """What is known of the strings that a part matches: all of them
    (``exact``), or a query that holds in each."""

    def __init__(self, exact=None, query=None):
        self.exact, self.query = exact, query

    def as_query(self):
        return _strings(self.exact) if self.exact is not None else self.query


def _sequence(infos) -> _Info:
    run, queries = {""}, []
    whole = True
    for i in infos:
        if i.exact is not None and len(run) * len(i.exact) <= _MAX_EXACT:
            run = {a + b for a in run for b in i.exact}
            continue
        queries.append(_strings(run))
        whole = False
        if i.exact is not None:
            run = set(i.exact)
        else:
            queries.append(i.query)
            run = {""}
    if whole:
        return _Info(exact=run)
    return _Info(query=_all_of(*queries, _strings(run)))


def _walk(parsed) -> _Info:
    out = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(_Info(exact={chr(arg).lower() if arg < 128 else chr(arg)}))
        elif name == "IN" and len(arg) <= 8 and all(str(k) == "LITERAL" for k, _ in arg):
            out.append(_Info(exact={chr(c).lower() if c < 128 else chr(c) for _, c in arg}))
        elif name == "SUBPATTERN":
            out.append(_walk(arg[-1]))
        elif name == "BRANCH":
            parts = [_walk(p) for p in arg[1]]
            if all(p.exact is not None for p in parts) and \
                    sum(len(p.exact) for p in parts) <= _MAX_EXACT:
                out.append(_Info(exact=set().union(*(p.exact for p in parts))))
            else:
                out.append(_Info(query=_any_of(*(p.as_query() for p in parts))))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, part = arg
            inner = _walk(part)
            if low == 0 and high == 1 and inner.exact is not None:
                out.append(_Info(exact=inner.exact | {""}))
            elif low >= 1:
                out.append(_Info(query=inner.as_query()))
            else:
                out.append(_Info())
        elif name == "AT" or name in ("ASSERT", "ASSERT_NOT"):
            continue                            # takes no characters
        else:
            out.append(_Info())                 # a set, any character, a reference
    return _sequence(out)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression."""
    return _walk(re._parser.parse(pattern)).as_query()


def trigrams_in(query) -> set[bytes]:
    if query is None:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams_in(q) for q in query[1]))


class TrigramIndex:
    """Postings (sorted text numbers) of the wanted trigrams in a block."""

    def __init__(self, data: np.ndarray, off: np.ndarray, slot: np.ndarray, n_slots: int):
        """``slot``: for every 24-bit trigram its number from 1, or 0."""
        self.n = len(off) - 1
        self.lists = [np.zeros(0, np.int64)] * (n_slots + 1)
        if len(data) < 3:
            return
        code = data[:-2].astype(np.int32)
        code <<= 8
        code |= data[1:-1]
        code <<= 8
        code |= data[2:]
        s = slot[code]
        at = np.flatnonzero(s)
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[doc + 1]
        pair = np.unique(s[at[inside]].astype(np.int64) * self.n + doc[inside])
        which = pair // max(self.n, 1)
        for k, lo, hi in zip(*_runs(which)):
            self.lists[k] = pair[lo:hi] - k * self.n

    def matching(self, query, number: dict[bytes, int]) -> np.ndarray:
        """Texts in which the query holds; lists are met from the shortest."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.lists[number[query]]
        found = sorted((self.matching(q, number) for q in query[1]), key=len)
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True) if query[0] == "and" \
                else np.union1d(out, f)
        return out


def _runs(values: np.ndarray):
    if len(values) == 0:
        return [], [], []
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)]


def slot_table(wanted: set[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    number = {t: i + 1 for i, t in enumerate(sorted(wanted))}
    slot = np.zeros(1 << 24, dtype=np.uint16)
    for t, i in number.items():
        slot[(t[0] << 16) | (t[1] << 8) | t[2]] = i
    return slot, number

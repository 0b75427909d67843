"""Two-stage suffix sorting of chosen suffixes, and their common prefixes.

A suffix is of type B if it is smaller than its successor, else of type A.
Type B suffixes are sorted directly; a scan over the buckets of first bytes, in
order, then places every type A suffix when its successor is met: behind the
type A suffixes already placed in its bucket, before the bucket's type B ones.
Suffixes are told apart by their first ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one that starts a byte later."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    up = text[:-1] < text[1:]
    differs = np.r_[text[:-1] != text[1:], True]
    at = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]         # next place where bytes differ
    out[:-1] = np.r_[up, False][nxt[:-1]]
    return out


def closed_under_induction(text: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Positions first..last of every range, continued to the next type B
    suffix (or the end of the text), and the types of all suffixes."""
    kind = smaller_than_successor(text)
    n = len(text)
    nxt = np.minimum.accumulate(np.where(kind, np.arange(n), n - 1)[::-1])[::-1]
    end = nxt[last]
    wanted = np.zeros(n + 1, dtype=np.int32)
    np.add.at(wanted, first, 1)
    np.add.at(wanted, end + 1, -1)
    return np.flatnonzero(np.cumsum(wanted[:n]) > 0), kind


def two_stage_order(text: bytes, chosen: np.ndarray, kind: np.ndarray, depth: int) -> np.ndarray:
    """The chosen suffixes in lexicographic order of their first ``depth``
    bytes.  ``chosen`` is closed: the successor of a type A suffix is chosen
    too, unless it is the empty one."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    is_a = np.zeros(n + 1, dtype=bool)
    is_a[chosen] = ~kind[chosen]
    direct = chosen[kind[chosen]]
    # first stage: sort the type B suffixes
    ranked = sorted(direct.tolist(), key=lambda i: text[i:i + depth])
    direct = np.array(ranked, dtype=np.int64)
    edges = np.searchsorted(data[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and is_a[n - 1]:
        queue[data[n - 1]].append(np.array([n - 1]))    # its successor is empty
    out = []
    for c in range(256):
        # second stage: what smaller buckets have placed here, then what that
        # places in this same bucket (runs of one byte)
        got = queue[c]
        if got:
            now = np.concatenate(got)
            got = [now]
            while len(now):
                back = now[now > 0] - 1
                now = back[is_a[back] & (data[back] == c)]
                if len(now):
                    got.append(now)
        bucket = np.concatenate([*got, direct[edges[c]:edges[c + 1]]])
        if len(bucket) == 0:
            continue
        bucket = bucket.astype(np.int64)
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        back = back[is_a[back] & (data[back] > c)]
        if len(back):
            byte = data[back]
            order = np.argsort(byte, kind="stable")
            back, byte = back[order], byte[order]
            cut = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(back, cut):
                queue[data[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def adjacent_common_prefixes(text: bytes, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, at most ``cap``, of every suffix and the one before it in
    ``order`` (0 for the first)."""
    padded = np.frombuffer(text + b"\0" * 16, np.uint8)
    words = np.ndarray((len(text) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    n = len(text)
    out = np.zeros(len(order), dtype=np.int64)
    a, b = order[:-1], order[1:]
    most = np.minimum(cap, n - np.maximum(a, b))        # neither runs past the end
    live = np.arange(len(a))
    done = 0
    same = np.zeros(len(a), dtype=np.int64)
    while len(live) and done < cap:
        x = words[np.minimum(a[live] + done, n)] ^ words[np.minimum(b[live] + done, n)]
        equal = x == 0
        low = x[~equal]
        first = np.zeros(len(low), dtype=np.int64)      # equal low-order bytes
        for k in range(1, 8):
            first += (low & np.uint64((1 << 8 * k) - 1)) == 0
        same[live[~equal]] = done + first
        live = live[equal]
        done += 8
        same[live] = done
    out[1:] = np.minimum(same, np.maximum(most, 0))
    return out


def repeated_starts(segments: list[bytes], last_start: np.ndarray, copies: np.ndarray,
                    length: int) -> list[np.ndarray]:
    """For every segment the starts 0..last_start whose ``length`` bytes also
    start elsewhere among the segments, or in one of several copies of it."""
    text = b"".join(segments)
    size = np.array([len(s) for s in segments], dtype=np.int64)
    base = np.cumsum(size) - size
    chosen, kind = closed_under_induction(np.frombuffer(text, np.uint8), base,
                                          base + last_start)
    order = two_stage_order(text, chosen, kind, length)
    common = adjacent_common_prefixes(text, order, length)
    owner = np.searchsorted(base, order, side="right") - 1
    asked = order - base[owner] <= last_start[owner]
    run = np.cumsum(common < length)                    # suffixes that share `length` bytes
    weight = np.bincount(run, weights=np.where(asked, copies[owner], 0))
    hit = asked & (weight[run] >= 2)
    at, who = order[hit] - base[owner[hit]], owner[hit]
    by = np.lexsort((at, who))
    at, who = at[by], who[by]
    edge = np.searchsorted(who, np.arange(len(segments) + 1))
    return [at[edge[i]:edge[i + 1]] for i in range(len(segments))]

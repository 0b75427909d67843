"""Brute-force versions of the operators, over plain Python rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACED = re.compile("[^\x20\x09-\x0d]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def spaced_words(text):
    return SPACED.findall((text or "").translate(LOWER))


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def repeated_bytes(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the kept bytes) per text."""
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=5):
    w = spaced_words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


class Groups:
    def __init__(self, n):
        self.parent = list(range(n))

    def root(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, i, j):
        self.parent[self.root(i)] = self.root(j)


def near_duplicates(rows, percent):
    """{row number: (set size, component id)} of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    g = Groups(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    g.join(i, j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = g.root(i)
        if doc is not None and sets[i]:
            low[r] = min(low.get(r, doc), doc)
    return [(len(sets[i]), low.get(g.root(i), rows[i][0])) for i in range(len(rows))]


def contamination(docs, items, n=10):
    """[(n_words, n_hit, item ids)] of texts, for (item id, text) items."""
    where = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            where[tuple(w[i:i + n])].add(item)
    out = []
    for text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in where}:
            for i in range(len(w) - size + 1):
                got = where.get(tuple(w[i:i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def license_blocks(text, templates, least):
    """(labels, highest containment) over all runs of ceil(words / least) words."""
    w = words(text)
    labels, best = set(), 0
    for label, body in templates:
        t = words(body)
        wide, tokens = math.ceil(len(t) / least - 1e-9), set(t)
        top = max(len(tokens & set(w[i:i + wide])) for i in range(max(len(w) - wide, 0) + 1))
        if top >= math.ceil(least * len(tokens) - 1e-9):
            labels.add(label)
            best = max(best, top / len(tokens))
    return labels, best


BASE = (("assign", re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])"
                              r"|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])"
                              r"|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?"
                              r"([A-Za-z0-9+/_.=-]+)"), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def secrets(text):
    """Base spans (start, kind number, end), sorted."""
    return sorted((m.start(), k, m.end()) for k, (_, expr, group, least) in enumerate(BASE)
                  for m in expr.finditer(text or "") if len(m[group]) >= least)


def base_scores(rows):
    """[(held out, tokens, known, N, base score)] of (id, text) rows."""
    out = []
    fold = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    tokens = [[*spaced_words(t), None] for _, t in rows]
    count = collections.Counter(w for h, t in zip(fold, tokens) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for h, t in zip(fold, tokens):
        out.append((h, len(t), sum(count[w] > 0 for w in t), n,
                    sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)))
    return out


def near_vectors(rows, least):
    """[(links, component)] of (id, label, vector) rows."""
    import numpy as np

    ok, unit = [], []
    for _, label, v in rows:
        good = (label is not None and v is not None and len(v) > 0
                and not any(x is None or not math.isfinite(x) for x in v) and any(v))
        ok.append(good)
        unit.append(np.array(v, dtype=float) / np.linalg.norm(v) if good else None)
    links = [0] * len(rows)
    g = Groups(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                g.join(i, j)
    low = {}
    for i, (vec, _, _) in enumerate(rows):
        if ok[i] and vec is not None:
            low[g.root(i)] = min(low.get(g.root(i), vec), vec)
    return [(links[i], low.get(g.root(i), rows[i][0]) if ok[i] else rows[i][0])
            for i in range(len(rows))]

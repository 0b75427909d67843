"""Ranked lexical search by pair-bound MaxScore (operator 12).

Every document is scanned once for its length and the terms that any query
holds.  From these postings the *pair lists* are computed ahead of any query:
the terms of an item are paired in order of weight, and for every distinct pair
the documents holding both are intersected, keeping how many they are and the
maximum of their joint impact, next to the maximum impact of each term alone.  A
pair then bounds a document by ``max(joint, first, second)``, never more than
the sum of the two maxima, so that more of the cheap pairs of an item cannot
lift a document into its results.  The same pass keeps the best partial scores
of each item's heaviest pair: their ``k``-th is a threshold that holds from the
start.

Queries run against shards of documents (some 2^20 postings each) in tasks:
documents of the essential pairs' lists are added up, those that cannot reach
the threshold even with the bounds of all other pairs are left, the others are
completed list by list.  A shard's best ``k`` raise the task's threshold; the
tasks' lists are merged by rank.  Only whole texts count, scores are exact
64-bit integers, and skipping is by strict comparison, so ties are never lost.

Queries go in blocks of about ``ITEM_TERMS`` term places (one longer query is a
block of its own); a block's terms, weights and bounds are all that is sent to
the driver and the tasks, and each block scans the documents anew.  Terms are
told apart by 64-bit fingerprints.

A null or empty text has no terms: such a document is not counted, such an item
has no results.  Rows that repeat both id and text are one item, but each is a
document of its own; rows that share an id only stay apart.  Equal scores go by
ascending id (null last), then by text fingerprint.  Other columns are not read,
whatever their names.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparselm.llm import textblock
from sparselm.llm.tables import discard, saved, table, text_key

ITEM_TERMS = 1 << 20
SHARD_POSTINGS = 1 << 20
IS_TERM_BYTE = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IS_TERM_BYTE[_a:_b + 1] = True


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def _counted(key: np.ndarray, doc: np.ndarray, n: int):
    """Distinct keys per text with their counts: (key, count, keys per text)."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], np.diff(np.append(at, len(key))), np.bincount(doc[at], minlength=n)


def _item_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in textblock.text_slices(whole, "text"):
            h, doc = textblock.word_hashes(*textblock.block(b.column("text")), IS_TERM_BYTE)
            key, count, size = _counted(h, doc, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("tkey"), _lists(key.view(np.int64), size, pa.int64()),
                 _lists(count, size, pa.int32()),
                 pa.array(np.bincount(doc, minlength=b.num_rows), pa.int64())],
                names=["id", "tkey", "terms", "counts", "n"])


def _term_pass(vocabulary: np.ndarray):
    """Per document with terms: its length, and the counts of vocabulary terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textblock.text_slices(whole, "text"):
                h, doc = textblock.word_hashes(*textblock.block(b.column("text")), IS_TERM_BYTE)
                n = np.bincount(doc, minlength=b.num_rows)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[at] == h
                key, count, size = _counted(at[known], doc[known], b.num_rows)
                out = pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("tkey"), pa.array(n, pa.int64()),
                     _lists(key, size, pa.int32()), _lists(count, size, pa.int32())],
                    names=["id", "tkey", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))
    return run


@dataclass
class Query:
    """One item: its pairs of (term, repeats) in order of weight; bounds and
    the threshold known before it runs."""
    pairs: list                         # [((term, repeats), ...)], two terms or one
    bound: list = field(default_factory=list)
    threshold: int = 0


@dataclass
class Weights:
    n_docs: int
    n_terms: int
    w: np.ndarray                       # by vocabulary place

    def impacts(self, term, count, n) -> np.ndarray:
        """w * ((10^9 tf) div (1000 tf + 12 m))."""
        top = 25 * self.n_docs
        if top * int(n.max(initial=0)) < 2 ** 63:
            m = 75 + (top * n) // self.n_terms
        else:
            m = np.array([75 + top * int(x) // self.n_terms for x in n], dtype=np.int64)
        return self.w[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m))


class Shard:
    """Postings of some documents: per term its documents and impacts."""

    def __init__(self, b: pa.RecordBatch, weights: Weights):
        size = b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term = b.column("terms").flatten().to_numpy(zero_copy_only=False)
        count = b.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.repeat(b.column("n").to_numpy(zero_copy_only=False), size)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.impact = weights.impacts(term, count, n)[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights.w) + 1))
        self.n = len(size)
        self._ids = b.column("id")
        self._tags = b.column("tkey")

    def list(self, term: int):
        a, b = self.start[term], self.start[term + 1]
        return self.doc[a:b], self.impact[a:b]

    def keys(self, at: np.ndarray):
        """(id or None, text fingerprint) of documents."""
        return (self._ids.take(pa.array(at)).to_pylist(), self._tags.take(pa.array(at)).to_pylist())


def _shards(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[Shard]:
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // SHARD_POSTINGS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield Shard(b.slice(lo, hi - lo), weights)


def _best(keys: list, k: int) -> list:
    """The k first of (score, id, tag): highest score, ids ascending, null last."""
    return sorted(keys, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:k]


TERM, PAIR, LEAD = 0, 1, 2


def _list_pass(weights: Weights, pairs: list, leads: list, k: int):
    """Maxima of terms and pairs, and the best partial scores of each item's
    first pair, one set per task: (kind, place, value, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(len(weights.w), np.int64)
        joint, both = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        lead = [np.zeros(0, np.int64) for _ in leads]
        for s in _shards(batches, weights):
            some = np.flatnonzero(np.diff(s.start))
            if len(some):
                top[some] = np.maximum(top[some], np.maximum.reduceat(s.impact, s.start[some]))
            buf = np.zeros(s.n, np.int64)
            for p, ((a, ra), (b, rb)) in enumerate(pairs):
                da, ia = s.list(a)
                db, ib = s.list(b)
                if not len(da) or not len(db):
                    continue
                buf[da] = ia + 1                        # 0: not in the first list
                met = buf[db]
                at = np.flatnonzero(met)
                if len(at):
                    both[p] += len(at)
                    joint[p] = max(joint[p], int((ra * (met[at] - 1) + rb * ib[at]).max()))
                buf[da] = 0
            for q, pair in enumerate(leads):
                if not pair:
                    continue
                for t, r in pair:
                    d, i = s.list(t)
                    buf[d] += r * i
                d = np.concatenate([s.list(t)[0] for t, _ in pair])
                value = buf[np.unique(d)]
                buf[d] = 0
                lead[q] = -np.sort(-np.concatenate([lead[q], value[value > 0]]))[:k]
        kind = [np.full(len(top), TERM), np.full(len(pairs), PAIR)] + [
            np.full(len(v), LEAD) for v in lead]
        place = [np.arange(len(top)), np.arange(len(pairs))] + [
            np.full(len(v), q) for q, v in enumerate(lead)]
        n = [np.zeros(len(top)), both] + [np.zeros(len(v)) for v in lead]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(kind), pa.int32()), pa.array(np.concatenate(place), pa.int32()),
             pa.array(np.concatenate([top, joint, *lead]), pa.int64()),
             pa.array(np.concatenate(n).astype(np.int64), pa.int64())],
            names=["kind", "place", "value", "n"])
    return run


def search_shard(s: Shard, q: Query, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that may score ``threshold`` or more, with their
    scores; skips by the pair bounds."""
    order = np.argsort(q.bound, kind="stable")
    below = np.cumsum(np.asarray(q.bound, dtype=np.int64)[order])
    cheap = int(np.searchsorted(below, threshold, side="left"))     # bounds sum to less
    score = np.zeros(s.n, np.int64)
    for u in order[cheap:].tolist():
        for t, r in q.pairs[u]:
            d, i = s.list(t)
            score[d] += r * i
    at = np.flatnonzero(score)
    score = score[at]
    for j in range(cheap - 1, -1, -1):
        keep = score + below[j] >= threshold
        at, score = at[keep], score[keep]
        if not len(at):
            break
        for t, r in q.pairs[order[j]]:
            d, i = s.list(t)
            if len(d):
                near = np.minimum(np.searchsorted(d, at), len(d) - 1)
                score += np.where(d[near] == at, r * i[near], 0)
    keep = (score >= threshold) & (score > 0)
    return at[keep], score[keep]


def _search_pass(weights: Weights, queries: list, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        for s in _shards(batches, weights):
            for j, q in enumerate(queries):
                least = q.threshold
                if len(best[j]) == k:
                    least = max(least, best[j][-1][0])
                at, score = search_shard(s, q, least)
                if len(at) > k:                          # all that tie with the k-th stay
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    at, score = at[score >= cut], score[score >= cut]
                if len(at):
                    ids, tags = s.keys(at)
                    best[j] = _best(best[j] + list(zip(score.tolist(), ids, tags)), k)
        rows = [(j, *x) for j, b in enumerate(best) for x in b]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.int64()), pa.array(cols[1], pa.int64())],
            names=["item", "doc", "dtag", "score"])
    return run


def _search_block(spark: SparkSession, src: DataFrame, items: list, k: int) -> DataFrame:
    """Results of one block of items (id, tkey, terms, counts)."""
    vocabulary = np.unique(np.concatenate([np.asarray(i["terms"], dtype=np.int64).view(np.uint64)
                                           for i in items]))
    docs = saved(spark, src.mapInArrow(
        _term_pass(vocabulary), "id long, tkey long, n long, terms array<int>, counts array<int>"),
        "rs-postings")
    n_docs, n_terms = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = Weights(n_docs, n_terms, np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64))

    queries, number = [], {}
    for i in items:
        at = np.searchsorted(vocabulary, np.asarray(i["terms"], dtype=np.int64).view(np.uint64))
        terms = sorted(((int(t), int(r)) for t, r in zip(at, i["counts"]) if df[t]),
                       key=lambda x: (-x[1] * weights.w[x[0]], x[0]))
        queries.append(Query([tuple(terms[j:j + 2]) for j in range(0, len(terms), 2)]))
        for p in queries[-1].pairs:
            if len(p) == 2:
                number.setdefault(p, len(number))
    lists = saved(spark, docs.mapInArrow(
        _list_pass(weights, list(number), [q.pairs[0] if q.pairs else () for q in queries], k)
        if n_docs else _no_lists, "kind int, place int, value long, n long"), "rs-pair-lists")
    most = {(r["kind"], r["place"]): r["value"] for r in lists.where(F.col("kind") != LEAD)
            .groupBy("kind", "place").agg(F.max("value").alias("value")).collect()}
    w = Window.partitionBy("place").orderBy(F.desc("value"))
    kth = {r["place"]: r["value"] for r in lists.where(F.col("kind") == LEAD).withColumn(
        "rank", F.row_number().over(w)).where(F.col("rank") == k).collect()}
    for j, q in enumerate(queries):
        q.threshold = kth.get(j, 0)
        for p in q.pairs:
            alone = [r * most.get((TERM, t), 0) for t, r in p]
            joint = most.get((PAIR, number[p]), 0) if len(p) == 2 else 0
            q.bound.append(max([joint, *alone]))

    found = docs.mapInArrow(_search_pass(weights, queries, k) if n_docs else _no_results,
                            "item int, doc long, dtag long, score long")
    w = Window.partitionBy("item").orderBy(
        F.desc("score"), F.col("doc").asc_nulls_last(), "dtag")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(j, i["id"], i["tkey"]) for j, i in enumerate(items)],
                                  "item int, item_id long, item_tkey long")
    out = saved(spark, found.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.col("doc").alias("doc_id"), "score", "item_tkey",
        F.col("dtag").alias("doc_tkey")), "rs-found")
    discard(spark, docs, lists)
    return out


def _no_lists(batches):
    for _ in batches:
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([], pa.int32()), "place": pa.array([], pa.int32()),
            "value": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})


def _no_results(batches):
    for _ in batches:
        yield pa.RecordBatch.from_pydict({
            "item": pa.array([], pa.int32()), "doc": pa.array([], pa.int64()),
            "dtag": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20,
                  doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_terms: int = ITEM_TERMS) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank (from 1), doc_id, score,
    and the text fingerprints item_tkey, doc_tkey.  Ids are 64-bit integers."""
    src = docs.select(F.col(doc_col).cast("long").alias("id"),
                      text_key(text_col).alias("tkey"), F.col(text_col).alias("text"))
    asked = saved(spark, items.select(
        F.col(item_col).cast("long").alias("id"), text_key(item_text_col).alias("tkey"),
        F.coalesce(item_text_col, F.lit("")).alias("text")).distinct().mapInArrow(
        _item_pass, "id long, tkey long, terms array<long>, counts array<int>, n long"), "rs-items")
    asked_some = asked.where(F.size("terms") > 0)
    total = asked_some.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    out = []
    for b in range(blocks):
        part = asked_some.where(F.pmod(F.xxhash64("id", "tkey"), F.lit(blocks)) == b).collect()
        if part:
            out.append(_search_block(spark, src, part, k))
    discard(spark, asked)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, "
                                         "item_tkey long, doc_tkey long")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark, table(spark, sf_dir, "documents"),
                         table(spark, sf_dir, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
asked AS (
  SELECT item_id, term, count(*) AS r
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item_id, term),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words
             WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), total),
impacts AS (
  SELECT p.doc_id, p.term,
         w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact
  FROM postings p JOIN weights USING (term) JOIN sizes USING (doc_id), total),
scores AS (
  SELECT item_id, doc_id, sum(r * impact)::BIGINT AS score
  FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
       doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

"""Hard-negative mining over anchor-clustered shared lists (operator 13).

Anchors are clustered by direction.  For a cluster every candidate has one
upper bound on its inner product with any member: with the centroid at angle t
and the members within r of the centroid, ``|c| cos(max(0, t - r))`` times the
member's norm.  The candidates are sorted by that bound once per cluster; every
member walks the shared list in chunks and stops when the next bound can no
longer enter any list it keeps (certified termination).  The first walk finds an
anchor's positives, the second the negatives of all its score bands at once.

Work is dealt out in (anchor batch, candidate block) pairs of bounded bytes:
anchors are repeated per block and candidates per batch, so no task and no
driver holds all anchors or all rows, and a hot label or id is spread by hash.
A block's lists are merged by rank.  The centroids are fitted on a bounded
sample of anchors (``SAMPLE``); they only decide which anchors share a list, and
the result does not depend on them.

Components are held as floor(scale * x) in 64-bit integers, so scores are exact.
Rows without id or label, with a null vector or a null or non-finite component
take no part.  Identical rows (id, label, components) are one row; rows that
share an id but differ are rows of their own, told apart by a fingerprint that
breaks the tie after the id.  Vectors of another dimension than the anchor's are
no candidates of it.  Components beyond sqrt(2^62 / dimension) are held there,
so that sums stay within 64 bits.  Other columns are not read, whatever their
names.  An empty table, or no anchor, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparselm.llm.tables import discard, saved, table

SAMPLE = 4096               # anchors the centroids are fitted on, at most
CLUSTERS = 64               # at most
MEMBERS = 1024              # anchors that share one walk
BLOCK_BYTES = 16 << 20      # vectors of one block, and of one anchor batch
CHUNK = 1024                # candidates a member meets at a time
_SLACK = 1e-6               # radians; the arc cosine errs by less
_NONE = np.iinfo(np.int64).min


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first k rows; empty clusters keep their place."""
    u = _unit(x.astype(np.float64))
    c = u[:k].copy()
    for _ in range(rounds):
        near = np.argmax(u @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, u)
        c = np.where((total * total).sum(axis=1, keepdims=True) > 0, _unit(total), c)
    return c


def reach(q: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Upper bound of every candidate's inner product with a member of norm 1."""
    u = _unit(members)
    c = _unit(u.sum(axis=0))
    radius = np.arccos(np.clip(u @ c, -1, 1)).max() + _SLACK
    norm = np.sqrt((q * q).sum(axis=1))
    angle = np.arccos(np.clip((q @ c) / np.where(norm > 0, norm, 1), -1, 1))
    return norm * (np.cos(np.maximum(angle - radius, 0)) + 1e-9)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def walk(anchors: dict, rows: dict, k: int, low: np.ndarray, high: np.ndarray, same: bool):
    """The first ``k`` candidates (score, then id, then tag) of every member and
    band ``low <= score <= high``, of the anchor's label or of other labels.
    Arrays ``id, tag, lab, q`` each; returns (member, band, row, score) and the
    number of products formed."""
    m, bands = low.shape
    out, met = [], 0
    if not m or not len(rows["id"]):
        return out, met
    bound = reach(rows["q"].astype(np.float64), anchors["q"].astype(np.float64))
    order = np.argsort(-bound, kind="stable")
    norm = np.sqrt((anchors["q"].astype(np.float64) ** 2).sum(axis=1))
    score = np.full((m, bands, k), _NONE)
    place = np.full((m, bands, k), -1)
    live = high >= low
    for at in range(0, len(order), CHUNK):
        idx = order[at:at + CHUNK]
        # certified: nothing further can enter any of the member's lists
        best = norm * bound[idx[0]] + 1e-6
        need = np.maximum(score[:, :, -1], low)
        open_ = np.flatnonzero((live & (best[:, None] >= need)).any(axis=1))
        if not len(open_):
            break
        met += len(open_) * len(idx)
        s = _products(anchors["q"][open_], rows["q"][idx])
        fits = rows["lab"][idx][None, :] == anchors["lab"][open_][:, None]
        if same:
            fits &= ~((rows["id"][idx][None, :] == anchors["id"][open_][:, None])
                      & (rows["tag"][idx][None, :] == anchors["tag"][open_][:, None]))
        else:
            fits = ~fits
        for b in range(bands):
            ok = fits & (s >= need[open_, b][:, None]) & (s <= high[open_, b][:, None])
            for r in np.flatnonzero(ok.any(axis=1)).tolist():
                a, new = open_[r], np.flatnonzero(ok[r])
                have = place[a, b] >= 0
                sc = np.concatenate([score[a, b][have], s[r][new]])
                at_row = np.concatenate([place[a, b][have], idx[new]])
                first = np.lexsort((rows["tag"][at_row], rows["id"][at_row], -sc))[:k]
                score[a, b, :len(first)] = sc[first]
                place[a, b, :len(first)] = at_row[first]
    for a, b, j in zip(*np.nonzero(place >= 0)):
        out.append((int(a), int(b), int(place[a, b, j]), int(score[a, b, j])))
    return out, met


def _columns(t: pa.Table) -> tuple[dict, np.ndarray, list[np.ndarray]]:
    """(id, tag, lab arrays; vector lengths; vectors per row as one flat array
    with offsets)."""
    t = t.combine_chunks()
    cols = {c: t.column(c).to_numpy() for c in ("id", "tag", "lab")}
    q = t.column("q").combine_chunks()
    if isinstance(q, pa.ChunkedArray):
        q = pa.concat_arrays(q.chunks) if q.num_chunks else pa.array([], pa.list_(pa.int64()))
    size = q.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return cols, size, q.flatten().to_numpy(zero_copy_only=False)


def _of_length(cols: dict, size: np.ndarray, flat: np.ndarray, dim: int):
    """Rows of one dimension, with their row numbers."""
    at = np.flatnonzero(size == dim)
    start = (np.cumsum(size) - size)[at]
    part = {c: v[at] for c, v in cols.items()}
    part["q"] = flat[start[:, None] + np.arange(dim)[None, :]]
    return part, at


def _pair_fn(k: int, same: bool, low_pct: int = 0, high_pct: int = 0):
    """Walks of one (anchor batch, candidate block) pair."""
    names = ["aid", "atag", "band", "id", "tag", "score"]
    schema = pa.schema([(n, pa.int32() if n == "band" else pa.int64()) for n in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            acols, asize, aflat = _columns(left)
            rcols, rsize, rflat = _columns(right)
            cluster = left.column("cluster").to_numpy()
            scores = None if same else left.column("scores").to_pylist()
            for dim in np.unique(asize).tolist():
                rows, _ = _of_length(rcols, rsize, rflat, dim)
                anchors, number = _of_length(acols, asize, aflat, dim)
                for c in np.unique(cluster[number]).tolist():
                    mine = np.flatnonzero(cluster[number] == c)
                    for lo in range(0, len(mine), MEMBERS):
                        at = mine[lo:lo + MEMBERS]
                        part = {n: v[at] for n, v in anchors.items()}
                        if same:
                            low = np.full((len(at), 1), _NONE + 1)
                            high = np.full((len(at), 1), np.iinfo(np.int64).max)
                        else:
                            known = [scores[i] for i in number[at].tolist()]
                            n = max(map(len, known))
                            low, high = np.ones((len(at), n), np.int64), np.zeros((len(at), n), np.int64)
                            for i, ps in enumerate(known):
                                low[i, :len(ps)] = [-(-low_pct * p // 100) for p in ps]
                                high[i, :len(ps)] = [high_pct * p // 100 for p in ps]
                        got, _ = walk(part, rows, k, low, high, same)
                        found += [(part["id"][a], part["tag"][a], b, rows["id"][r],
                                   rows["tag"][r], s) for a, b, r, s in got]
        cols = list(zip(*found)) if found else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(np.asarray(c), f.type)
                                     for c, f in zip(cols, schema)], schema=schema)
    return run


_FOUND = "aid long, atag long, band int, id long, tag long, score long"


def _usable_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str,
                 anchor: Column, scale: int) -> DataFrame:
    """(id, lab, q, tag, anchor): rows that take part, identical ones once."""
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    most = F.floor(F.sqrt(F.lit(2.0 ** 62) / F.greatest(F.size(v), F.lit(1))))
    src = vectors.select(F.col(id_col).cast("long").alias("id"),
                         F.xxhash64(F.col(label_col)).alias("lab"),
                         F.col(label_col).isNotNull().alias("named"),
                         F.col(vector_col).cast("array<double>").alias("vector"),
                         F.coalesce(anchor, F.lit(False)).alias("anchor"))
    q = F.transform(v, lambda x: F.greatest(-most, F.least(most, F.floor(x * F.lit(float(scale))))))
    return (src.where(F.col("id").isNotNull() & F.col("named") & v.isNotNull()
                      & ~F.exists(v, bad))
            .select("id", "lab", q.alias("q"), "anchor")
            .groupBy("id", "lab", "q").agg(F.max("anchor").alias("anchor"))
            .withColumn("tag", F.xxhash64("lab", "q")))


def _clustered(rows: DataFrame, per_batch: int) -> tuple[DataFrame, int]:
    """Anchors with their cluster and batch, and the number of batches."""
    anchors = rows.where("anchor").select("id", "tag", "lab", "q")
    sample = [r["q"] for r in anchors.orderBy(F.xxhash64("id", "tag"), "id", "tag").limit(
        SAMPLE).select("q").collect()]
    by_dim = {d: np.array([v for v in sample if len(v) == d], dtype=np.float64)
              for d in {len(v) for v in sample}}
    centre = {d: centroids(x, max(1, min(CLUSTERS, len(x) // 32))) for d, x in by_dim.items()}

    def assign(batches):
        for b in batches:
            cols, size, flat = _columns(pa.Table.from_batches([b]))
            cluster = np.full(b.num_rows, -1, np.int32)
            for d, c in centre.items():
                part, at = _of_length(cols, size, flat, d)
                cluster[at] = np.argmax(_unit(part["q"].astype(np.float64)) @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster)],
                                             names=[*b.schema.names, "cluster"])

    named = anchors.mapInArrow(assign, "id long, tag long, lab long, q array<long>, cluster int")
    # at most CLUSTERS + 1 counts; clusters lie one after the other, cut into batches
    counts = {r["cluster"]: r["count"] for r in named.groupBy("cluster").count().collect()}
    start, at = [], 0
    for c in range(-1, CLUSTERS):
        start.append(at)
        at += counts.get(c, 0)
    size = [max(counts.get(c, 0), 1) for c in range(-1, CLUSTERS)]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 2)
    place = pick(start) + F.pmod(F.xxhash64("id", "tag"), pick(size).cast("long"))
    return (named.withColumn("batch", F.floor(place / per_batch).cast("int")),
            max(1, -(-at // per_batch)))


def hard_negatives(spark: SparkSession, vectors: DataFrame, anchor: Column,
                   id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 10,
                   low_pct: int = 30, high_pct: int = 90, scale: int = 256) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of another label
    whose score lies between ``low_pct`` and ``high_pct`` percent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score (and the fingerprints anchor_tag, positive_tag,
    negative_tag).  ``anchor`` is a condition on the columns of ``vectors``."""
    rows = saved(spark, _usable_rows(vectors, id_col, vector_col, label_col, anchor, scale),
                 "hn-rows")
    n, dim = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    each = 8 * max(dim or 1, 8)
    per_block = max(1, BLOCK_BYTES // each)
    wide = 2 * spark.sparkContext.defaultParallelism
    blocks = max(-(-n // per_block), min(wide, -(-n // 2048)), 1)
    anchors, batches = _clustered(rows, per_block)
    anchors = saved(spark, anchors, "hn-anchors")
    dealt = rows.select("id", "tag", "lab", "q",
                        F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).cast("int").alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def walked(side: DataFrame, fn) -> DataFrame:
        return (side.select("*", every).groupBy("batch", "block")
                .cogroup(dealt.groupBy("batch", "block")).applyInArrow(fn, _FOUND))

    def first(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("aid", "atag", "band").orderBy(F.desc("score"), "id", "tag")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    near = first(walked(anchors, _pair_fn(positives, True)), positives)
    near = near.groupBy("aid", "atag").agg(F.sort_array(F.collect_list(
        F.struct("rank", "id", "tag", "score"))).alias("near"))     # at most `positives`
    paired = saved(spark, anchors.join(near, (F.col("id") == F.col("aid"))
                                       & (F.col("tag") == F.col("atag"))).select(
        "id", "tag", "lab", "q", "cluster", "batch", "near"), "hn-positives")
    found = first(walked(paired.select("id", "tag", "lab", "q", "cluster", "batch",
                                       F.col("near.score").alias("scores")),
                         _pair_fn(negatives, False, low_pct, high_pct)), negatives)
    known = paired.select(F.col("id").alias("aid"), F.col("tag").alias("atag"),
                          F.posexplode("near").alias("band", "p"))
    out = saved(spark, found.join(known, ["aid", "atag", "band"]).select(
        F.col("aid").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"), F.col("atag").alias("anchor_tag"),
        F.col("p.tag").alias("positive_tag"), F.col("tag").alias("negative_tag")), "hn-found")
    discard(spark, rows, anchors, paired)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    src = src.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(spark, src, F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.q) = len(r.q)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                          ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                           ORDER BY s.score DESC, s.id) <= 10
"""

"""Quality classifier by nearest-neighbour voting (operator 8).

Texts are byte 3-gram counts, hashed, damped and weighted by rarity, next to
counts of words that repeat the word before them; a truncated singular value
decomposition of a bounded sample of labelled texts gives the latent-semantic
axes.  The sample's vectors and labels (``SAMPLE`` x
``AXES`` numbers, the same at every corpus size) are sent to every task, which
takes exact cosine products of each document with all of them in blocks and
weighs the labels of the ``NEIGHBOURS`` nearest by a power of the similarity.
Only the text is an input of a score.

A null or empty text has no grams; it scores the sample's share of label 1.
Labels that are null are not learned from; a repeated label row counts once per
distinct label.  Without any labelled text every score is 0.5.  Repeated rows
score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselm.llm import textblock
from sparselm.llm.tables import crc_mod5, table

SAMPLE = 4096               # labelled texts learned from, at most
GRAMS = 2048                # hashed byte 3-grams (a power of two)
REPEATS = 16                # columns that carry the count of repeated words
FEATURES = GRAMS + REPEATS
AXES = 64
NEIGHBOURS = 11
POWER = 8                   # of the similarity, as a neighbour's weight
THRESHOLD = 0.3


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts x FEATURES counts; neither grams nor words cross texts."""
    n = len(off) - 1
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if len(data) >= 3:
        code = data[:-2].astype(np.uint32) * np.uint32(0x9E3779B1)
        code ^= data[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77)
        code ^= data[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D)
        code *= np.uint32(0x27D4EB2F)
        code >>= np.uint32(33 - GRAMS.bit_length())
        doc = np.repeat(np.arange(n), np.diff(off))[:-2]
        at = doc * GRAMS + code
        crossing = np.concatenate([off[1:] - 1, off[1:] - 2])
        keep = np.ones(len(at), dtype=bool)
        keep[crossing[(crossing >= 0) & (crossing < len(at))]] = False
        # an empty text may put its neighbour's end at the same byte: no harm
        out[:, :GRAMS] = np.bincount(at[keep], minlength=n * GRAMS).reshape(n, GRAMS)
        word, doc = textblock.word_hashes(data, off)
        again = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        out[:, GRAMS:] = np.bincount(doc[1:][again], minlength=n)[:, None]
    return out


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    x *= rarity
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x /= np.where(size > 0, size, 1)
    return x


def _unit(z: np.ndarray) -> np.ndarray:
    size = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return z / np.where(size > 0, size, 1)


class Model(NamedTuple):
    """Rarity weights, axes, and the labelled vectors."""

    labels: np.ndarray
    base: float
    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, axes: int = AXES) -> "Model":
        n = len(labels)
        labels = labels.astype(np.float32)
        rarity = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.05
        x = _weighted(counts, rarity)
        # subspace iteration for the leading right singular vectors
        basis = np.random.Generator(np.random.PCG64(8)).standard_normal(
            (x.shape[1], axes + 16)).astype(np.float32)
        for _ in range(8):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
        axes = np.ascontiguousarray((basis @ right.T)[:, :axes]).astype(np.float32)
        return cls(labels, float(labels.mean()) if n else 0.5, rarity, axes, _unit(x @ axes))

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS,
               power: int = POWER) -> np.ndarray:
        out = np.full(len(counts), self.base)
        some = np.flatnonzero(counts.sum(axis=1) > 0)
        k = min(neighbours, len(self.labels))
        if k == 0:
            return out
        for lo in range(0, len(some), 512):
            at = some[lo:lo + 512]
            z = _unit(_weighted(counts[at], self.rarity) @ self.axes)
            sim = z @ self.vectors.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, near, 1), 1e-3).astype(np.float64) ** power
            out[at] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in textblock.text_slices(whole, "text"):
            counts = gram_counts(*textblock.block(b.column("text"), lower=False))
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array([c.astype("<f4").tobytes() for c in counts],
                                             pa.binary())], names=["label", "counts"])


def _fit_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows, as one row of little-endian float32 bytes."""
    rows, labels = [], []
    for b in batches:
        rows += [np.frombuffer(c.as_buffer(), "<f4") for c in b.column("counts")]
        labels += b.column("label").to_pylist()
    counts = np.stack(rows) if rows else np.zeros((0, FEATURES), np.float32)
    del rows
    order = np.lexsort(counts.T[:8])            # the same model whatever the row order
    counts = counts[order]
    m = Model.fit(counts, np.array(labels, dtype=float)[order])
    yield pa.RecordBatch.from_arrays(
        [pa.array([m.base], pa.float64()),
         *(pa.array([x.astype("<f4").tobytes()], pa.binary())
           for x in (m.labels, m.rarity, m.axes, m.vectors))],
        names=["base", "labels", "rarity", "axes", "vectors"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled texts: those of smallest id hash."""
    picked = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
              .distinct().orderBy(F.xxhash64("id"), "label").limit(sample))
    # at most `sample` rows on the broadcast side; a repeated document of the
    # sample is one text, so the collected counts stay within the bound
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(F.broadcast(picked), "id")
             .groupBy("id", "label").agg(F.max("text").alias("text")))
    counted = texts.select("label", "text").mapInArrow(
        _count_pass, "label double, counts binary")
    # the sample's counts (34 MB at most) meet in one task; the driver gets the
    # model alone (2 MB)
    row = counted.repartition(1).mapInArrow(
        _fit_pass, "base double, labels binary, rarity binary, axes binary, vectors binary").first()
    if row is None:             # an empty plan runs no task
        return Model.fit(np.zeros((0, FEATURES), np.float32), np.zeros(0))
    wide = {k: np.frombuffer(row[k], "<f4") for k in ("labels", "rarity", "axes", "vectors")}
    n_axes = len(wide["axes"]) // FEATURES
    return Model(wide["labels"], row["base"], wide["rarity"],
                 wide["axes"].reshape(FEATURES, n_axes),
                 wide["vectors"].reshape(len(wide["labels"]), n_axes))


def score_of(spark: SparkSession, text: Column, model: Model) -> Column:
    """Score of a text (0 to 1).  Only the text travels to Python; the model is
    broadcast as plain arrays, which executors read without this package."""
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(*shared.value)
        for texts in batches:
            parts = [known.scores(gram_counts(*textblock.block(part, lower=False)))
                     for part in textblock.array_slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return run(text)


def score(docs: DataFrame, model: Model, text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """(row: the columns ``keep`` of ``docs``, by default all; score: 0 to 1)."""
    return docs.select(F.struct(*(keep or ["*"])).alias("row"),
                       score_of(docs.sparkSession, F.col(text_col), model).alias("score"))


def train_split(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Label rows that may be learned from."""
    return labels.where(crc_mod5(id_col) != 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, train_split(table(spark, sf_dir, "labels")))
    return score(docs, model, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), (crc_mod5("row.doc_id") == 0).alias("held_out"),
        "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

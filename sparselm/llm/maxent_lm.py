"""Language-model scoring by a hashed maximum-entropy model (operator 9).

The next word's probability is P(class | context) * P(word | class).  The class
factor is a softmax over ``CLASSES`` strata of word frequency whose features are
the previous word, the word before it, and both, hashed to ``BUCKETS`` contexts
each.  P(word | class) is the word's share of its class: a softmax with one
weight per word, whose maximum likelihood is known in closed form.  In the last
class the event "a word not seen in training" takes the share ``UNKNOWN``, the
known words share the rest by their counts.  The events of the model are those
of the base score: the training words, and one for all others.

Training: one exact distributed word count over all training documents, then
``ROUNDS`` rounds of distributed gradient updates, each over its own share of
all training documents.  In a round every task runs mini-batch gradient steps
from the common weights; the tasks' updates are averaged by their tokens, in
two grouped steps, and only the sum (the size of the model) reaches the driver.
Weights and lexicon are of fixed size at any corpus size; the word counts stay
distributed and are joined to the tokens that the lexicon does not hold.

Words are told apart by 64-bit fingerprints.  A null or empty text is one end
token.  Without training documents counts are 0 and the model is uniform.
Repeated rows train and are scored as often as they occur; a null id counts as
''.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselm.llm import textblock
from sparselm.llm.tables import crc_mod5, saved, table

LEXICON = 1 << 18
CLASSES = 32                # the last one for words out of the lexicon
BUCKETS = 4096              # hashed contexts of each feature
FEATURES = 3
ROUNDS = 2
STEP = 0.3
UNKNOWN = 0.5               # of the last class: words not seen in training
BATCH = 4096                # tokens of one gradient step
_END = np.uint64(0x5EED_0000_0000_0E0F)         # the end token
_EDGE = np.uint64(0x5EED_0000_0000_0001)        # context before a text
_FLUSH = 1_000_000          # distinct words counted before a task emits
_BLOCK = 16_384             # weights of one aggregated row
_LANE = 64                  # tasks added up together


def _tokens(batch: pa.RecordBatch):
    """(fingerprint, text index) of all tokens in order; each text ends with
    the end token."""
    word, doc = textblock.word_hashes(*textblock.block(batch.column("text")))
    n = batch.num_rows
    at = np.searchsorted(doc, np.arange(n), side="right")       # behind a text's words
    return np.insert(word, at, _END), np.insert(doc, at, np.arange(n))


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)],
                                          names=["word", "n"])
    for whole in batches:
        for b in textblock.text_slices(whole, "text"):
            w, c = np.unique(_tokens(b)[0], return_counts=True)
            every = np.concatenate([words, w])
            words, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, c])).astype(np.int64)
            if len(words) > _FLUSH:
                yield rows()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield rows()


@dataclass
class Model:
    words: np.ndarray           # lexicon, sorted fingerprints
    counts: np.ndarray
    cls: np.ndarray             # class of each lexicon word
    inside: np.ndarray          # log P(word | class)
    weights: np.ndarray         # FEATURES * BUCKETS x CLASSES
    bias: np.ndarray

    def lookup(self, word: np.ndarray):
        """(lexicon row, in the lexicon)."""
        if len(self.words) == 0:
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return at, self.words[at] == word

    def classes(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        if len(self.words) == 0:
            return np.full(len(at), CLASSES - 1)
        return np.where(known, self.cls[at], CLASSES - 1)


def _shared(spark: SparkSession, model: Model):
    """Broadcast as plain arrays, which executors read without this package."""
    return spark.sparkContext.broadcast((model.words, model.counts, model.cls, model.inside,
                                         model.weights, model.bias))


def initial_model(words: np.ndarray, counts: np.ndarray, total: int) -> Model:
    """Lexicon and class shares from word counts; no context weights yet."""
    by = np.lexsort((words, -counts))
    mass = np.cumsum(counts[by]) - counts[by] / 2
    cls = np.empty(len(words), dtype=np.int64)
    cls[by] = np.minimum(mass * (CLASSES - 1) / max(counts.sum(), 1), CLASSES - 2).astype(np.int64)
    share = np.bincount(cls, weights=counts, minlength=CLASSES).astype(float)
    inside = np.log(counts / np.maximum(share[cls], 1e-300))
    share[CLASSES - 1] = total - counts.sum()
    order = np.argsort(words)
    return Model(words[order], counts[order], cls[order].astype(np.int16),
                 inside[order].astype(np.float32),
                 np.zeros((FEATURES * BUCKETS, CLASSES), np.float32),
                 np.log((share + 1) / (share + 1).sum()).astype(np.float32))


def contexts(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Feature rows of every token: previous word, word before it, both."""
    one = np.full(len(word), _EDGE, np.uint64)
    two = one.copy()
    same = doc[1:] == doc[:-1]
    one[1:][same] = word[:-1][same]
    same = doc[2:] == doc[:-2]
    two[2:][same] = word[:-2][same]
    out = np.empty((len(word), FEATURES), np.int32)
    skip = textblock.mix(two ^ np.uint64(0xA5A5A5A5))
    for k, h in enumerate((textblock.mix(one), skip, textblock.mix(one * textblock.ODD + skip))):
        out[:, k] = (h & np.uint64(BUCKETS - 1)).astype(np.int32) + k * BUCKETS
    return out


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]]
    for k in range(1, FEATURES):
        z += weights[rows[:, k]]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def gradient_steps(weights: np.ndarray, seen: np.ndarray, bias: np.ndarray, rows: np.ndarray,
                   target: np.ndarray, step: float = STEP) -> None:
    """Mini-batch steps in place; a feature's step shrinks with its use."""
    for lo in range(0, len(rows), BATCH):
        r, t = rows[lo:lo + BATCH], target[lo:lo + BATCH]
        g = np.exp(_logits(weights, bias, r))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(t)), t] -= 1
        flat = r.ravel()
        order = np.argsort(flat, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
        total = np.add.reduceat(g[order // FEATURES], head, axis=0)
        at = flat[order[head]]
        seen[at] += np.diff(np.r_[head, len(order)])
        weights[at] -= (step / np.sqrt(1 + seen[at]))[:, None] * total


def _train_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        weights = model.weights.copy()
        seen = np.zeros(len(weights), np.float32)
        n = 0
        for whole in batches:
            for b in textblock.text_slices(whole, "text"):
                word, doc = _tokens(b)
                at, known = model.lookup(word)
                gradient_steps(weights, seen, model.bias, contexts(word, doc),
                               model.classes(at, known))
                n += len(word)
        if n == 0:
            return
        lane = TaskContext.get().partitionId() // _LANE
        delta = ((weights - model.weights) * np.float32(n)).ravel()
        for k, i in enumerate(range(0, len(delta), _BLOCK)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([float(n)]),
                 pa.array([delta[i:i + _BLOCK].astype("<f4").tobytes()], pa.binary())],
                names=["part", "lane", "tokens", "sums"])
    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of a part of the model over a group of tasks, in single precision."""
    total = np.zeros(len(pdf["sums"].iloc[0]) // 4)
    for s in pdf["sums"]:
        total += np.frombuffer(s, "<f4")
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "lane": pdf["lane"].iloc[:1],
                         "tokens": [pdf["tokens"].sum()], "sums": [total.astype("<f4").tobytes()]})


def log_probabilities(model: Model, word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Natural logarithm of P of every token; of tokens out of the lexicon only
    their class's share."""
    at, known = model.lookup(word)
    cls = model.classes(at, known)
    rows = contexts(word, doc)
    out = np.zeros(len(word))
    for lo in range(0, len(word), BATCH):
        z = _logits(model.weights, model.bias, rows[lo:lo + BATCH])
        t = cls[lo:lo + BATCH]
        out[lo:lo + BATCH] = z[np.arange(len(t)), t] - np.log(np.exp(z).sum(axis=1))
    if len(model.words):
        out += np.where(known, model.inside[at], 0)
    return out


def _score_pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        row = TaskContext.get().partitionId() << 40         # rows are written once
        for whole in batches:
            for b in textblock.text_slices(whole, "text"):
                word, doc = _tokens(b)
                n = b.num_rows
                at, known = model.lookup(word)
                logp = log_probabilities(model, word, doc)
                base = np.log10(model.counts[at] + 0.5) if len(model.words) else np.zeros(len(at))
                rest = np.flatnonzero(~known)
                edge = np.searchsorted(doc[rest], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), b.column("id"),
                     pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                     pa.array(np.bincount(doc[known], minlength=n).astype(np.int64)),
                     pa.array(np.bincount(doc[known], weights=base[known], minlength=n)
                              .astype(float)),                  # int if all are unknown
                     pa.array(np.bincount(doc, weights=logp, minlength=n) / np.log(10)),
                     pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)),
                                              pa.array(word[rest].view(np.int64)))],
                    names=["row", "id", "n_tokens", "n_lexicon", "base", "score", "rest"])
                row += n
    return run


def train(spark: SparkSession, docs: DataFrame, share: Column, text_col: str = "text",
          lexicon: int = LEXICON, rounds: int = ROUNDS) -> tuple[Model, DataFrame, int, int]:
    """(model, word counts, N, V) of training documents; ``share`` is an
    integer that deals the documents to the rounds."""
    src = docs.select(F.col(text_col).alias("text"), share.alias("share"))
    counts = saved(spark, src.select("text").mapInArrow(_count_pass, "word long, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where("n > 1").orderBy(F.col("n").desc(), "word").limit(lexicon).toArrow()
    model = initial_model(top["word"].to_numpy().view(np.uint64),
                          top["n"].to_numpy().astype(np.int64), int(n))
    kind = "part int, lane int, tokens double, sums binary"
    for r in range(rounds):
        shared = _shared(spark, model)
        part = src.where(F.pmod(F.col("share"), F.lit(rounds)) == r).select("text")
        sums = (part.mapInArrow(_train_pass(shared), kind)
                .groupBy("part", "lane").applyInPandas(_added, kind)
                .groupBy("part").applyInPandas(_added, kind)).collect()     # one model
        by = {x["part"]: x for x in sums}
        w = model.weights.ravel().copy()
        for i, at in enumerate(range(0, len(w), _BLOCK)):
            if i in by:
                w[at:at + _BLOCK] += (np.frombuffer(by[i]["sums"], "<f4")
                                      / by[i]["tokens"]).astype(np.float32)
        model = Model(model.words, model.counts, model.cls, model.inside,
                      w.reshape(model.weights.shape), model.bias)
    return model, counts, int(n), int(v)


def score_texts(spark: SparkSession, docs: DataFrame, model: Model, counts: DataFrame, n: int,
                v: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_tokens, n_known, base_score, score."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = _shared(spark, model)
    L, D = T.LongType(), T.DoubleType()
    rows = saved(spark, src.mapInArrow(_score_pass(shared), T.StructType([
        T.StructField("row", L), src.schema["id"], T.StructField("n_tokens", L),
        T.StructField("n_lexicon", L), T.StructField("base", D), T.StructField("score", D),
        T.StructField("rest", T.ArrayType(L))])), "lm-rows")
    rest = rows.select("row", F.explode("rest").alias("word")).join(counts, "word", "left")
    others = max(n - int(model.counts.sum()), 1)        # training tokens out of the lexicon
    rest = rest.groupBy("row").agg(
        F.count("n").alias("more_known"),
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_base"),
        F.sum(F.when(F.col("n") > 0, F.log10((1 - UNKNOWN) * F.col("n") / others))
              .otherwise(F.log10(F.lit(UNKNOWN)))).alias("more_score"))
    out = rows.drop("rest").join(rest, "row", "left")
    return out.select(
        "id", "n_tokens", (F.col("n_lexicon") + F.coalesce("more_known", F.lit(0)))
        .cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))
         - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    model, counts, n, v = train(spark, docs.where(crc_mod5() != 1), F.floor(crc / 5))
    return score_texts(spark, docs, model, counts, n, v).select(
        F.col("id").alias("doc_id"), (crc_mod5("id") == 1).alias("held_out"), "n_tokens",
        "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

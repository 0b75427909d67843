"""Personal data by weak supervision (operator 11).

Candidate spans of six kinds come from loose patterns; regex, gazetteer and
context labelers vote on each (:mod:`.pii_labelers`).  The votes of all
candidates of the corpus are counted per kind and vote pattern (at most
6 x 3^7 numbers); expectation-maximisation on these counts estimates how often
every labeler is right, without any labelled span, and turns each pattern into a
probability.  A logistic span classifier on hashed features of the span and its
surroundings is then trained on all candidates against these probabilities, in
distributed rounds over distinct feature sets with counts (copies are added up
first).  A candidate that the classifier takes for personal data is a span.

The base rules' spans are always kept; others are added where they overlap no
span already there (longer first, then higher score, then earlier).  Texts are read
once; candidates travel without them.  Only the pattern counts and ``FEATURES``
sums a round reach the driver.

A null or empty text has no spans.  Texts of any length are scanned whole, in
linear time.  Repeated rows are scanned each (and their candidates counted
each); other columns pass through untouched whatever their names.  Spans of
equal length and score go by their start.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselm.llm import pii_labelers as L
from sparselm.llm import textblock
from sparselm.llm.tables import discard, saved, table

FEATURES = 4096             # hashed features of the classifier
ROUNDS = 15
LEAST_SCORE = 0.5
RATE, DECAY = 0.5, 1e-4
#: how often a labeler that speaks is taken to be right before any count, and the
#: weight of that in shares of the candidates
PRIOR_RIGHT = {"format": 0.75, "check": 0.97, "listed": 0.8, "sentinel": 0.9, "cue": 0.8,
               "counter_cue": 0.8, "boundary": 0.85}
PRIOR_SHARE = 0.1

_CAND = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                   ("base", pa.bool_()), ("votes", pa.int32()),
                   ("features", pa.list_(pa.int32()))])
_CAND_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()),
    T.StructField("votes", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.IntegerType()))]))
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                   ("base", pa.bool_()), ("score", pa.float64())])
_SPAN_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()),
    T.StructField("score", T.DoubleType())]))


def _candidate_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in textblock.text_slices(whole, "text"):
            found = []
            for s in b.column("text").to_pylist():
                found.append([
                    {"kind": k, "start": lo, "end": hi, "base": ok,
                     "votes": L.code(L.votes(s, k, lo, hi)),
                     "features": L.features(s, k, lo, hi, FEATURES)}
                    for k, lo, hi, ok in L.candidates(s)] if s else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(found, pa.list_(_CAND))], names=["row", "cands"])


class Reliabilities:
    """Per kind: share of true candidates, and of every labeler the
    probabilities of its three votes given the truth (0 or 1).  A labeler of
    ``decisive`` that speaks against a candidate settles it: a failed checksum
    or range is no opinion."""

    def __init__(self, counts: dict, rounds: int = 100, decisive: tuple = ("check",)):
        """``counts``: (kind, vote code) -> number of candidates."""
        self.decisive = [L.LABELERS.index(x) for x in decisive]
        self.share: dict[int, float] = {}
        self.table: dict[int, np.ndarray] = {}      # truth x labeler x vote
        self.posterior: dict[tuple[int, int], float] = {}
        for kind in sorted({k for k, _ in counts}):
            codes = sorted(c for k, c in counts if k == kind)
            n = np.array([counts[kind, c] for c in codes], dtype=np.float64)
            self._fit(kind, codes, np.array([L.decoded(c) for c in codes]), n, rounds)

    def _fit(self, kind, codes, vote, n, rounds):
        labelers = vote.shape[1]
        seen = np.stack([vote == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
        # prior counts keep truth 1 on the side that most labelers speak for
        right = np.array([PRIOR_RIGHT[x] for x in L.LABELERS]) / 2
        half = np.full(labelers, 0.5)
        prior = np.stack([np.stack([right, half, 0.5 - right], axis=1),
                          np.stack([0.5 - right, half, right], axis=1)])
        prior *= 1 + PRIOR_SHARE * n.sum()
        possible = (vote[:, self.decisive] >= 0).all(axis=1)
        p = possible / (1 + np.exp(-vote.sum(axis=1, dtype=np.float64)))
        extra = 1 + PRIOR_SHARE * n.sum()
        for _ in range(rounds):
            weight = np.stack([n * (1 - p), n * p])
            share = (weight[1].sum() + extra / 2) / (n.sum() + extra)
            table = np.einsum("tc,clv->tlv", weight, seen) + prior
            table /= table.sum(axis=2, keepdims=True)
            logs = np.einsum("clv,tlv->tc", seen, np.log(table))
            new = possible / (1 + np.exp(np.clip(
                np.log((1 - share) / share) + logs[0] - logs[1], -500, 500)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        self.share[kind], self.table[kind] = float(share), table.reshape(2, labelers, 3)
        self.posterior.update(((kind, c), float(x)) for c, x in zip(codes, p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _margins(weights: np.ndarray, features: pa.Array) -> np.ndarray:
    flat = features.flatten().to_numpy(zero_copy_only=False)
    size = features.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    return np.bincount(row, weights[flat], minlength=len(size)), flat, row


def _gradient_pass(weights: np.ndarray, posterior: dict):
    """Sums of one task: (feature, gradient of the log-loss, candidates)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, seen = np.zeros(len(weights)), np.zeros(len(weights))
        for b in batches:
            if not b.num_rows:
                continue
            margin, flat, row = _margins(weights, b.column("features"))
            n = b.column("n").to_numpy().astype(np.float64)
            truth = np.array([posterior[x] for x in zip(b.column("kind").to_pylist(),
                                                        b.column("votes").to_pylist())])
            grad += np.bincount(flat, ((_sigmoid(margin) - truth) * n)[row], len(weights))
            seen += np.bincount(flat, n[row], len(weights))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(grad[at]), pa.array(seen[at])],
            names=["feature", "grad", "seen"])
    return run


def train(classes: DataFrame, posterior: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the span classifier: steps scaled per feature by its count
    and past gradients; sums are rounded, so that their order leaves no trace."""
    weights, past = np.zeros(FEATURES), np.zeros(FEATURES)
    for _ in range(rounds):
        sums = (classes.mapInArrow(_gradient_pass(weights, posterior),
                                   "feature int, grad double, seen double")
                .groupBy("feature").agg(F.sum("grad").alias("g"), F.sum("seen").alias("n"))
                .collect())
        g = np.zeros(FEATURES)
        for r in sums:
            g[r["feature"]] = round(r["g"], 6) / r["n"]
        g += DECAY * weights
        past += g * g
        weights = weights - np.round(RATE * g / np.sqrt(past + 1e-8), 12)
    return weights


def chosen(cands: list[dict], scores: list[float], least: float = LEAST_SCORE) -> list[dict]:
    """Base spans and the added ones of a text, by kind, then start."""
    out = [{"kind": L.KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": True,
            "score": s} for c, s in zip(cands, scores) if c["base"]]
    more = sorted(((c["start"] - c["end"], -s, c["start"], c["end"], c["kind"]) for c, s in zip(cands, scores)
                   if not c["base"] and s >= least))
    if more:
        taken = _union([(c["start"], c["end"]) for c in out])
        for _, s, lo, hi, kind in more:
            at = bisect.bisect_left(taken, (hi,))        # spans that begin before hi
            if at == 0 or taken[at - 1][1] <= lo:
                taken.insert(at, (lo, hi))
                out.append({"kind": L.KINDS[kind], "start": lo, "end": hi, "base": False,
                            "score": -s})
    out.sort(key=lambda x: (L.KINDS.index(x["kind"]), x["start"]))
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same places, sorted."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _score_pass(weights: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for cands in b.column("cands").to_pylist():
                scores = [float(_sigmoid(weights[c["features"]].sum())) for c in cands]
                spans.append(chosen(cands, scores, least))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(spans, pa.list_(_SPAN))], names=["row", "spans"])
    return run


def find_personal_data(spark: SparkSession, docs: DataFrame, text_col: str = "text",
                       keep: list[str] | None = None,
                       least: float = LEAST_SCORE) -> tuple[DataFrame, Reliabilities]:
    """(row: the columns ``keep`` of ``docs``, by default all; spans: array of
    kind, start, end, base, score, by kind, then start), and the labelers'
    estimated reliabilities."""
    src = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text_col).alias("text"))
    scanned = saved(spark, src.mapInArrow(_candidate_pass, T.StructType(
        [src.schema["row"], T.StructField("cands", _CAND_SCHEMA)])), "pii-candidates")
    classes = saved(spark, scanned.select(F.explode("cands").alias("c")).groupBy(
        "c.kind", "c.votes", "c.features").agg(F.count("*").alias("n")), "pii-classes")
    counts = {(r["kind"], r["votes"]): r["n"] for r in classes.groupBy("kind", "votes").agg(
        F.sum("n").alias("n")).collect()}
    known = Reliabilities(counts)
    weights = train(classes, known.posterior) if counts else np.zeros(FEATURES)
    out = saved(spark, scanned.mapInArrow(_score_pass(weights, least), T.StructType(
        [src.schema["row"], T.StructField("spans", _SPAN_SCHEMA)])), "pii-spans")
    discard(spark, scanned, classes)
    return out, known


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find_personal_data(spark, table(spark, sf_dir, "documents"), keep=["doc_id"])
    some = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(some, lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                     s["end"].cast("string"))), ",")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in L.BASE_KINDS],
        F.sha2(line(some).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"))

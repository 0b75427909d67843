"""Second-moment aggregates of a keyed dense matrix.

One scan produces, per group (an ADMM block, or any grouping key):

* ``g``  — row ``i`` of the Gram matrix ``AᵀA`` from the diagonal on,
  ``(AᵀA)[i, i:]`` (symmetric, so only the upper triangle is shuffled)
* ``c``  — ``(Aᵀb)_i``
* ``s``  — column sum ``Σ_rows A[:, i]``
* ``n``  — row count, ``yy`` — ``bᵀb``

as a *moments table* ``(keys..., i, g, c, s, n, yy)`` with p rows per group.

Plan: ``mapInArrow`` turns each task's Arrow batches into one running
``XᵀX`` per group (BLAS on contiguous float64 blocks, no per-row Python), and
emits p rows per group **per task**; a ``groupBy(keys, i)`` with an
element-wise vector sum (``Summarizer``) finishes the reduction. The shuffle is
therefore ``tasks × groups-per-task × p`` vectors, independent of the number
of rows, and a hot key is just one more local accumulator — no group is ever
gathered into one task. With :func:`partition_blocks` every task feeds exactly
one block, so the shuffle is ``tasks × p`` vectors.

Row-level Gram pairs are never materialised as rows (no self-join on the
sample key).
"""

from __future__ import annotations

from typing import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import sq_norm


def partition_blocks(n_blocks: int) -> Column:
    """Block id tied to the task that reads the row: ``partition_id mod N``.

    Any split of rows into blocks gives the same LASSO optimum; tying the block
    to the task means every task contributes to a single block, which keeps the
    moments shuffle minimal. Evaluate it in the same stage as the moments scan.
    """
    return F.pmod(F.spark_partition_id(), F.lit(int(n_blocks))).cast("long")


def hash_blocks(key, n_blocks: int) -> Column:
    """Block id from a hash of the sample key (stable across plans)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(k), F.lit(int(n_blocks))).cast("long")


def _list_array(mat: np.ndarray) -> pa.Array:
    rows, width = mat.shape
    offsets = pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1), type=pa.float64()))


def _upper_rows(G: np.ndarray) -> pa.Array:
    """Row i of a symmetric matrix from the diagonal on: ``G[i, i:]``."""
    p = G.shape[0]
    offsets = np.concatenate([[0], np.cumsum(p - np.arange(p))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets),
                                    pa.array(G[np.triu_indices(p)], type=pa.float64()))


def full_from_upper_rows(rows, p: int) -> np.ndarray:
    """Symmetric p×p matrix from rows ``i → G[i, i:]`` (in ``i`` order)."""
    G = np.zeros((p, p))
    for i, r in enumerate(rows):
        G[i, i:] = r
    return G + np.triu(G, 1).T


# memory a task may spend on open accumulators before it emits them early
ACCUMULATOR_BUDGET_BYTES = 256 << 20
# cells of the pair products that a task forms at a time
PAIR_CELLS = 1 << 21


def _pair_columns(X: np.ndarray) -> np.ndarray:
    """Main effects, then the products x_k·x_j for k<j in that order."""
    k, j = np.triu_indices(X.shape[1], 1)
    return np.concatenate([X, X[:, k] * X[:, j]], axis=1)


def _pair_slices(batches: Iterable[pa.RecordBatch], features: str):
    """Batches cut so that their pair products stay within ``PAIR_CELLS``."""
    for rb in batches:
        if rb.num_rows:
            p = rb.column(rb.schema.get_field_index(features)).value_lengths()[0].as_py() or 1
            step = max(1, PAIR_CELLS // (p * (p + 1) // 2))
            for lo in range(0, rb.num_rows, step):
                yield rb.slice(lo, step)


def _partials_fn(keys: list[str], features: str, label: str | None, width: int | None,
                 budget: int | None = None, pairs: bool = False):
    """Build the per-task accumulator used by ``mapInArrow``.

    One running ``XᵀX`` per group key seen by the task. When the open
    accumulators exceed the byte budget (many distinct keys in one task) they
    are emitted and reset: the downstream ``groupBy`` sums partials anyway, so
    memory stays bounded whatever the key cardinality.
    """
    limit = ACCUMULATOR_BUDGET_BYTES if budget is None else budget

    def emit(acc, ktypes, p):
        for key, (G, c, s, n, yy) in acc.items():
            cols = {k: pa.array([v] * p, type=ktypes[k]) for k, v in zip(keys, key)}
            cols.update({"i": pa.array(np.arange(p, dtype=np.int32)), "g": _upper_rows(G),
                         "c": pa.array(c), "s": pa.array(s),
                         "n": pa.array(np.full(p, n, dtype=np.int64)),
                         "yy": pa.array(np.full(p, yy))})
            yield pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterable[pa.RecordBatch]):
        acc: dict = {}
        ktypes: dict = {}
        p, wide = width, 0
        for rb in _pair_slices(batches, features) if pairs else batches:
            if rb.num_rows == 0:
                continue
            feats = rb.column(rb.schema.get_field_index(features))
            if feats.null_count:
                raise ValueError("null feature vector")
            lens = feats.value_lengths().to_numpy(zero_copy_only=False)
            if p is None:
                p = int(lens[0])
            if (lens != p).any():
                raise ValueError(f"ragged feature rows: expected {p} values, got "
                                 f"{sorted(set(lens.tolist()))[:5]}")
            flat = feats.flatten()
            if flat.null_count:
                raise ValueError("null feature value")
            X = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, p)
            if pairs:
                X = _pair_columns(X)
            wide = X.shape[1]
            if label is not None:
                ycol = rb.column(rb.schema.get_field_index(label))
                if ycol.null_count:
                    raise ValueError("null response value")
                y = ycol.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            else:
                y = np.zeros(X.shape[0])
            if keys:
                # codes per key column; nulls are a group like any other
                codes = np.zeros(rb.num_rows, dtype=np.int64)
                for kf in keys:
                    d = rb.column(rb.schema.get_field_index(kf)).dictionary_encode(
                        null_encoding="encode")
                    codes = codes * max(len(d.dictionary), 1) + d.indices.to_numpy(
                        zero_copy_only=False)
                    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
                rows_of = pa.array(first)
                uniq = list(zip(*(rb.column(rb.schema.get_field_index(k)).take(rows_of)
                                  .to_pylist() for k in keys)))
                for kf in keys:
                    ktypes.setdefault(kf, rb.schema.field(kf).type)
                if len(uniq) == 1:
                    groups = [(uniq[0], None)]
                else:
                    order = np.argsort(codes, kind="stable")
                    bounds = np.searchsorted(codes[order], np.arange(len(uniq) + 1))
                    groups = [(uniq[g], order[bounds[g]:bounds[g + 1]]) for g in range(len(uniq))]
            else:
                groups = [((), None)]
            for key, rows in groups:
                Xg = X if rows is None else X[rows]
                yg = y if rows is None else y[rows]
                a = acc.get(key)
                if a is None:
                    a = acc[key] = [np.zeros((wide, wide)), np.zeros(wide), np.zeros(wide), 0, 0.0]
                a[0] += Xg.T @ Xg
                a[1] += Xg.T @ yg
                a[2] += Xg.sum(axis=0)
                a[3] += Xg.shape[0]
                a[4] += float(yg @ yg)
            if len(acc) * 8 * (wide * wide + 2 * wide + 2) > limit:
                yield from emit(acc, ktypes, wide)
                acc = {}
        yield from emit(acc, ktypes, wide)

    return run


def moments(df: DataFrame, features: str = "features", label: str | None = "label",
            keys: list[str] | None = None, width: int | None = None,
            pairs: bool = False) -> DataFrame:
    """Moments table ``(keys..., i, g, c, s, n, yy)``; see the module doc.

    ``features`` must be ``array<double>`` (cast floats first); rows must all
    have the same length. ``label=None`` gives ``c = yy = 0``. With ``pairs`` the
    moments are those of the features and their pairwise products.
    """
    keys = list(keys or [])
    return summed_moments(partial_moments(df, features, label, keys, width, pairs), keys)


def summed_moments(partial: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Moments table of per-task partial moments."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = list(keys or [])
    return (partial.groupBy(*keys, "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"),
        F.sum("c").alias("c"), F.sum("s").alias("s"),
        F.sum("n").alias("n"), F.sum("yy").alias("yy")))


def partial_moments(df: DataFrame, features: str = "features", label: str | None = "label",
                    keys: list[str] | None = None, width: int | None = None,
                    pairs: bool = False) -> DataFrame:
    """Per-task partial moments, before the cross-task sum: p rows per group
    and task. Stateless, so it also runs on a streaming DataFrame."""
    keys = list(keys or [])
    cols = keys + [features] + ([label] if label else [])
    src = df.select(*cols)
    fields = [src.schema[k] for k in keys]
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in fields] + [
            T.StructField("i", T.IntegerType(), False),
            T.StructField("g", T.ArrayType(T.DoubleType(), False), False),
            T.StructField("c", T.DoubleType(), False),
            T.StructField("s", T.DoubleType(), False),
            T.StructField("n", T.LongType(), False),
            T.StructField("yy", T.DoubleType(), False)])
    return src.mapInArrow(_partials_fn(keys, features, label, width, pairs=pairs), out_schema)


# ---------------------------------------------------------------- views


def gram(mom: DataFrame, keys: list[str] | None = None, upper: bool = True) -> DataFrame:
    """Long Gram ``(keys..., i, j, g)`` from a moments table (``i <= j`` if
    upper, both triangles otherwise)."""
    keys = list(keys or [])
    out = mom.select(*keys, "i", F.posexplode("g").alias("d", "g")).select(
        *keys, "i", (F.col("i") + F.col("d")).cast("int").alias("j"), "g")
    if not upper:
        mirror = out.where(F.col("j") > F.col("i")).select(
            *keys, F.col("j").alias("i"), F.col("i").alias("j"), "g")
        out = out.unionByName(mirror)
    return out


def xty(mom: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys..., i, xty)`` = Aᵀb."""
    return mom.select(*(keys or []), "i", F.col("c").alias("xty"))


def column_means(mom: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Element-wise vector mean ``(keys..., i, mean)``."""
    return mom.select(*(keys or []), "i", (F.col("s") / F.col("n")).alias("mean"))


def block_sq_norms(mom: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Σ over rows of ‖x‖² per group, i.e. trace(AᵀA) (A5), plus counts."""
    keys = list(keys or [])
    return (mom.groupBy(*keys).agg(
        F.sum(F.element_at("g", 1)).alias("sq_norm"),        # diagonal entry
        F.first("n").alias("n"), F.first("yy").alias("yy")))


def row_sq_norms(df: DataFrame, features: str = "features") -> DataFrame:
    """Per-row squared norm column (JVM higher-order function)."""
    return df.withColumn("sq_norm", sq_norm(features))


# ---------------------------------------------------------------- ridge solve


def _solve_groups(keys: list[str], rho: float):
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        p = len(pdf)
        G = full_from_upper_rows(pdf["g"].to_numpy(), p)
        c = pdf["c"].to_numpy(dtype=np.float64)
        L = np.linalg.cholesky(G + rho * np.eye(p))
        x = np.linalg.solve(L.T, np.linalg.solve(L, c))
        out = {k: pdf[k] for k in keys}         # of one value, null included
        return pd.DataFrame(out).assign(i=np.arange(p, dtype=np.int32), x=x)

    return solve


def ridge_solve(df: DataFrame, by: list[str], features: str = "features",
                label: str = "label", rho: float = 1.0) -> DataFrame:
    """Per group: ``x = (AᵀA + ρI)⁻¹ Aᵀb`` as ``(by..., i, x)``.

    The rows of a group are never gathered: the moments are aggregated first,
    then one ``applyInPandas`` call per group factors its p×p matrix
    (Cholesky; raises if it is not positive definite).
    """
    mom = moments(df, features, label, keys=by)
    schema = T.StructType([df.schema[k] for k in by] + [
        T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType())])
    return mom.groupBy(*by).applyInPandas(_solve_groups(by, float(rho)), schema)

"""Penalty-grid selection.

All λ values share one data scan and one factorisation (``LassoProblem``);
by default all fits advance in lockstep, one stage per round for the whole
grid; ``warm_start`` fits them one after another instead, each from the state
of the one before. In-sample MSE comes from the sufficient statistics,
``(zᵀAᵀAz − 2zᵀAᵀb + bᵀb)/n``, so no λ rescans the data.

:func:`cross_validate` takes the error on held-out folds instead: one scan gives
the moments of every fold, and a fold's training moments are the total minus its
own. :func:`strong_path` fits a descending path on the features that the strong
rule lets through, and repairs it by the gradient of all features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, written
from . import admm
from .local_fit import fit_moments
from .moments import _list_array, hash_blocks
from .reduction import added

GRID_SCHEMA = ("pos int, lambda double, mse double, objective double, iterations int, "
               "converged boolean, nnz int, seconds double")


@dataclass
class GridResult:
    results: DataFrame
    best: "admm.LassoFit"
    best_pos: int
    fits: list


def in_sample_mse(problem: "admm.LassoProblem", z: np.ndarray) -> float:
    zgz = admm._zgz(problem, z)
    sse = zgz - 2.0 * float(z @ problem.xty) + problem.yy
    return max(sse, 0.0) / problem.n


def lambda_grid(problem: "admm.LassoProblem", lambdas, warm_start: bool = False,
                **fit_kw) -> GridResult:
    """Fit every λ of the grid; pick the smallest in-sample MSE.

    ``warm_start=False`` (default) runs all λ in lockstep from zero
    (:func:`admm.fit_many`): one Spark stage per round for the whole grid.
    ``warm_start=True`` fits them one after another, each continuing from the
    previous state (the same optima, more rounds). Ties go to the earliest
    grid position. Returns the per-λ table and the *best* fit (not the last).
    """
    spark = problem.factors.sparkSession
    lambdas = [float(v) for v in lambdas]
    if warm_start:
        fits, state = [], None
        for lam in lambdas:
            f = admm.fit(problem, lam, init=state, **fit_kw)
            fits.append(f)
            state = f.state
    else:
        fits = admm.fit_many(problem, lambdas, **fit_kw)
    Z = np.stack([f.coef for f in fits])
    zgz = admm._zgz_many(problem, Z)
    rows = []
    for pos, (lam, f) in enumerate(zip(lambdas, fits)):
        sse = float(zgz[pos]) - 2.0 * float(f.coef @ problem.xty) + problem.yy
        mse = max(sse, 0.0) / problem.n
        obj = 0.5 * sse + lam * float(np.abs(f.coef).sum())
        rows.append((pos, lam, mse, obj, f.iterations, f.converged, f.nnz(), f.seconds))
    best_pos = min(range(len(rows)), key=lambda i: (rows[i][2], i))
    return GridResult(spark.createDataFrame(rows, GRID_SCHEMA), fits[best_pos], best_pos, fits)


def best_lambda(results: DataFrame) -> DataFrame:
    """Arg-min over the grid table as a query: ``min_by`` on (mse, pos)."""
    return results.agg(
        F.min_by("lambda", F.struct("mse", "pos")).alias("best_lambda"),
        F.min("mse").alias("best_mse"))


# ---------------------------------------------------------------- cross validation

FOLD_SCHEMA = ("fold long, pos int, lambda double, n long, sse double, mse double, nnz int, "
               "iterations int, converged boolean, coef array<double>")


def _fold_fn(lambdas: list[float], rho, fit_kw: dict):
    """Fit one fold's complement for every λ and take the error on the fold."""
    def run(batches):
        k = len(lambdas)
        for rb in batches:
            fold, n, yy = (rb.column(c).to_pylist() for c in ("block_id", "n", "yy"))
            for r in range(rb.num_rows):
                c, c_all, g, g_all = (admm._row_values(rb.column(x), r)
                                      for x in ("q0", "total_q0", "g", "total_g"))
                p = len(c)
                G = g.reshape(p, p)
                Z, rounds, ok = fit_moments((g_all - g).reshape(p, p), c_all - c, lambdas, rho,
                                            **fit_kw)
                sse = np.maximum(np.einsum("kj,jl,kl->k", Z, G, Z) - 2 * Z @ c + yy[r], 0.0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([fold[r]] * k, pa.int64()), pa.array(range(k), pa.int32()),
                    pa.array(lambdas), pa.array([n[r]] * k, pa.int64()), pa.array(sse),
                    pa.array(sse / n[r]), pa.array((Z != 0).sum(axis=1), pa.int32()),
                    pa.array(rounds, pa.int32()), pa.array(ok), _list_array(Z)],
                    names=["fold", "pos", "lambda", "n", "sse", "mse", "nnz", "iterations",
                           "converged", "coef"])
    return run


def cross_validate(df: DataFrame, lambdas, folds: int = 5, fold_col: Column | str | None = None,
                   features: str = "features", label: str = "label", rho: float | str = "auto",
                   **fit_kw) -> DataFrame:
    """Per fold and λ: the error on the fold of the fit to all other rows.

    A row's fold is a hash of the row, the same however the table is
    partitioned, or ``fold_col``. One scan sums the moments of every fold (no
    row is shuffled); the training moments of a fold are the total minus its own
    (p² numbers a fold, so p is that of dense blocks). All folds are fitted at
    once, one task each, all λ together. Output ``fold, pos, lambda, n, sse, mse,
    nnz, iterations, converged, coef``; a fold that holds all rows raises.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = df.sparkSession
    lambdas = [float(v) for v in lambdas]
    if fold_col is None:
        fold = hash_blocks(F.struct(F.col(features), F.col(label)), int(folds))
    else:
        fold = F.col(fold_col) if isinstance(fold_col, str) else fold_col
    stats, path = written(spark, admm.block_statistics(df, features, label, block_col=fold),
                          "folds")
    total = stats.agg(*[vector_to_array(Summarizer.sum(array_to_vector(c))).alias(f"total_{c}")
                        for c in ("g", "q0")], F.count(F.lit(1)).alias("folds"))
    n_folds = total.first()["folds"]
    if n_folds < 2:
        raise ValueError("cross validation needs rows in at least two folds")
    # one row of p² + p numbers, the size of a fold's own row
    work = stats.crossJoin(F.broadcast(total.drop("folds"))).repartition(n_folds, "block_id")
    out = work.mapInArrow(_fold_fn(lambdas, rho, fit_kw), FOLD_SCHEMA)
    found = spark.createDataFrame(out.toArrow())                # folds × λ rows
    delete_path(spark, path)
    return found


def cross_validated_best(results: DataFrame) -> DataFrame:
    """Per λ the error over all held-out rows, and whether it is the smallest
    (ties go to the earliest grid position). Errors are added in the order of
    the folds, so equal folds give equal sums however the rows lie."""
    by_fold = F.sort_array(F.collect_list(F.struct("fold", "sse")))     # a row a fold
    per = results.groupBy("pos", "lambda").agg(
        F.sum("n").alias("n"), F.aggregate(by_fold, F.lit(0.0), lambda t, x: t + x["sse"])
        .alias("sse")).withColumn("mse", F.col("sse") / F.col("n"))
    best = per.agg(F.min_by("pos", F.struct("mse", "pos")).alias("best_pos"))
    return per.crossJoin(F.broadcast(best)).select(
        "pos", "lambda", "n", "mse", (F.col("pos") == F.col("best_pos")).alias("best"))


# ---------------------------------------------------------------- strong rule

PATH_SCHEMA = ("pos int, lambda double, screened int, repaired int, passes int, nnz int, "
               "mse double, objective double, converged boolean")


@dataclass
class PathResult:
    """``results`` has one row per λ: features the rule let through (those of
    the iterate before included), features the gradient added, passes over the
    blocks; ``coefs`` is K×p."""
    results: DataFrame
    coefs: np.ndarray


def _columns_fn(at: np.ndarray, p: int, fat: bool, pairs: bool = False):
    """Gram matrix of the columns ``at``, summed over the blocks of a task."""
    def run(batches):
        total, n = np.zeros((len(at), len(at))), 0
        for rb in batches:
            for r in range(rb.num_rows):
                n += 1
                if pairs:
                    B = admm._pair_columns_t(admm._fat_row(rb.column("b"), r, p, True).x[0])[at]
                    total += B @ B.T
                    continue
                B = np.frombuffer(rb.column("b")[r].as_buffer(), "<f8").reshape(-1, p)[:, at]
                s = np.frombuffer(rb.column("s")[r].as_buffer(), "<f8")
                total += B.T @ B if fat else B.T @ (s[:, None] * B)
        yield pa.RecordBatch.from_arrays(
            [_list_array(total.reshape(1, -1)), pa.array([n], pa.int64())], names=["v", "nb"])
    return run


def _gradient_fn(z: np.ndarray, at: np.ndarray, p: int, fat: bool, pairs: bool = False):
    """``AᵀA z`` of a z that lives on the columns ``at``, summed over a task."""
    full = np.zeros((1, 1, p))
    full[0, 0, at] = z

    def run(batches):
        total, n = np.zeros(p), 0
        for rb in batches:
            for r in range(rb.num_rows):
                n += 1
                if pairs:
                    B = admm._fat_row(rb.column("b"), r, p, True)
                    total += B.back(B.dot(full))[0, 0]
                    continue
                B = np.frombuffer(rb.column("b")[r].as_buffer(), "<f8").reshape(-1, p)
                s = np.frombuffer(rb.column("s")[r].as_buffer(), "<f8")
                y = B[:, at] @ z
                total += (y if fat else s * y) @ B
        yield pa.RecordBatch.from_arrays(
            [_list_array(total[None, :]), pa.array([n], pa.int64())], names=["v", "nb"])
    return run


def strong_path(problem: "admm.LassoProblem", lambdas, tol: float = 1e-6,
                most: int | None = None, **fit_kw) -> PathResult:
    """Fit a descending path of penalties on screened features.

    With the solution at the λ before, a feature whose gradient is below
    ``2λ − λ_before`` is left out (the sequential strong rule). The fit runs on
    the moments of the remaining columns, summed over the blocks (one pass that
    sends only those columns' products); a second pass takes the gradient of
    *all* features, and those that break optimality by more than ``tol`` are
    added and the fit repeated, until none does. So screening never changes the
    answer. More than ``most`` (the widest dense block) remaining features go
    through :func:`admm.fit` instead. ``lambdas`` are fitted in descending
    order; the results keep the given positions.
    """
    spark = problem.factors.sparkSession
    p, fat, c = problem.p, problem.fat, problem.xty
    most = admm.DENSE_MAX_FEATURES if most is None else most
    cells = [x for x in problem.cells if x in ("b", "s")]
    schema = "v array<double>, nb long"
    lambdas = [float(v) for v in lambdas]
    coefs = np.zeros((len(lambdas), p))
    grad, z, before, rows = c.copy(), np.zeros(p), float(np.abs(c).max(initial=0.0)), []
    for pos in sorted(range(len(lambdas)), key=lambda i: (-lambdas[i], i)):
        lam = lambdas[pos]
        keep = (z != 0) | (np.abs(grad) >= 2 * lam - max(before, lam))
        screened, passes, ok = int(keep.sum()), 0, True
        while True:
            at = np.flatnonzero(keep)
            z = np.zeros(p)
            if len(at) > most:
                f = admm.fit(problem, lam, **fit_kw)
                z, ok = f.coef.copy(), f.converged
                passes += f.iterations
            elif len(at):
                v, _ = added(problem.factors.select(*cells).mapInArrow(
                    _columns_fn(at, p, fat, problem.pairs), schema), problem.partitions)
                small, _, done = fit_moments(v.reshape(len(at), -1), c[at], [lam], **fit_kw)
                z[at], ok = small[0], bool(done[0])
                passes += 1
            on = np.flatnonzero(z)
            gz = np.zeros(p)
            if len(on):
                gz, _ = added(problem.factors.select(*cells).mapInArrow(
                    _gradient_fn(z[on], on, p, fat, problem.pairs), schema), problem.partitions)
                passes += 1
            grad = c - gz
            wrong = ~keep & (np.abs(grad) > lam + tol)
            if not wrong.any():
                break
            keep |= wrong
        coefs[pos], before = z, lam
        sse = float(z @ gz) - 2 * float(z @ c) + problem.yy
        rows.append((pos, lam, screened, int(keep.sum()) - screened, passes, int(len(on)),
                     max(sse, 0.0) / problem.n, 0.5 * sse + lam * float(np.abs(z).sum()), ok))
    return PathResult(spark.createDataFrame(sorted(rows), PATH_SCHEMA), coefs)

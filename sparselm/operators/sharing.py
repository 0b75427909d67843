"""L1-penalised least squares split by *features*: sharing ADMM over column
blocks.

For tables with far more features than samples (markers, pair products) a block
is a range of columns of all samples, so no task holds a vector of all features
next to its data, and the only thing shared is a vector of one number per
sample. With N column blocks and mean ``m = (1/N) Σ A_j x_j``::

    x_j ← argmin ½‖A_j x_j − (A_j x_j + z − m − u)‖² + (λ/ρ)‖x_j‖₁
    z   ← (b + ρ(m + u)) / (N + ρ)
    u   ← u + m − z

Each block's subproblem is solved in its task by coordinate descent on the
columns that can be non-zero. Rounds stop when ``√N‖m − z‖`` and
``ρ√N‖z − z_old‖`` are below ``√n·abs + rel·(size)``.

The scan cuts its rows into tiles (a run of rows × a range of columns) which are
written once to the checkpoint folder and assembled into column blocks by one
shuffle. A block holds at most ``BLOCK_BYTES``; pair products are formed while
the tiles are cut. A round is one stage: x (the coefficients) and two
vectors of n numbers travel to the tasks, one vector of p + n numbers comes back,
added in levels. n is the number of samples of a wide table and bounded by
``MOST_SAMPLES``.

A table of more rows than columns (over ``REDUCED_ROWS`` rows, up to
``REDUCED_MOST`` columns) is reduced first: its second moments M = [A b]ᵀ[A b] are summed on the executors, and the
p + 1 rows R with RᵀR = M take the place of the n samples. R is [A b] in another
orthonormal basis, and rounds use inner products and norms of sample vectors
only, so the x of every round and the round that stops are those of the whole
table (up to rounding), at a cost that no longer grows with n.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, written
from .moments import _list_array, _pair_columns, full_from_upper_rows, moments
from .reduction import added

BLOCK_BYTES = 64 << 20
MOST_SAMPLES = 8 << 20
REDUCED_ROWS = 4096         # up to so many, or p + 1, the rows are kept as they are
REDUCED_MOST = 4096         # columns: second moments of 128 MB
_CHUNK_CELLS = 1 << 21      # cells a scanning task cuts into tiles at a time
_TILES = "block int, chunk long, rows int, cells binary"


def _tile_fn(edges: list[int], p0: int, pairs: bool):
    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 31
        step = max(1, _CHUNK_CELLS // edges[-1])
        for rb in batches:
            for lo in range(0, rb.num_rows, step):
                part = rb.slice(lo, step)
                feats, y = part.column(0), part.column(1)
                flat = feats.flatten()
                size = feats.value_lengths().to_numpy(zero_copy_only=False)
                if feats.null_count or flat.null_count or y.null_count or (size != p0).any():
                    raise ValueError(f"null or ragged rows: expected {p0} features and a response")
                X = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p0)
                if pairs:
                    X = _pair_columns(X)
                cells = [y.to_numpy(zero_copy_only=False).astype("<f8").tobytes()]
                cells += [np.ascontiguousarray(X[:, a:b].T).tobytes()
                          for a, b in zip(edges, edges[1:])]
                k = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(-1, k - 1), pa.int32()), pa.array([chunk] * k, pa.int64()),
                     pa.array([len(X)] * k, pa.int32()), pa.array(cells, pa.binary())],
                    names=["block", "chunk", "rows", "cells"])
                chunk += 1
    return run


def _assemble(t: pa.Table) -> pa.Table:
    """Tiles of a column block → its columns over all rows, in chunk order."""
    order = np.argsort(t.column("chunk").to_numpy())
    rows, cells = t.column("rows").to_numpy(), t.column("cells")
    A = np.concatenate([np.frombuffer(cells[int(i)].as_buffer(), "<f8").reshape(-1, rows[i])
                        for i in order], axis=1)
    return pa.table({"block": t.column("block").combine_chunks()[:1],
                     "a": pa.array([A.tobytes()], pa.binary())})


def _reduced_fn(edges: list[int]):
    """Moment rows of the whole table → column blocks of its equivalent rows; as
    blocks −1 and −2 the response there, and Aᵀb."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        p = edges[-1]
        c = t.column("c").to_numpy()
        M = np.zeros((p + 1, p + 1))
        M[:p, :p] = full_from_upper_rows([g.values.to_numpy() for ch in t.column("g").chunks
                                          for g in ch], p)
        M[:p, p] = M[p, :p] = c
        M[p, p] = t.column("yy")[0].as_py()
        s, V = np.linalg.eigh(M)
        R = V * np.sqrt(np.maximum(s, 0.0))          # row i: column i of the table
        cells = [R[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table({"block": pa.array([*range(len(cells)), -1, -2], pa.int32()),
                         "a": pa.array([*cells, R[p].tobytes(), c.astype("<f8").tobytes()],
                                       pa.binary())})
    return run


@dataclass
class ColumnBlocks:
    """``blocks``: ``block, a`` (binary, columns × len(b)), cached; ``edges``: first
    column of every block and p; ``b``: the response, in the rows' order (or
    that of the equivalent rows); ``n``: samples; ``xty``: Aᵀb, if it was summed."""
    blocks: DataFrame
    edges: list[int]
    b: np.ndarray
    names: DataFrame | None = None
    n: int = 0
    xty: np.ndarray | None = None

    @property
    def p(self) -> int:
        return self.edges[-1]

    @property
    def n_blocks(self) -> int:
        return len(self.edges) - 1

    def release(self) -> None:
        self.blocks.unpersist()


def column_blocks(df: DataFrame, features: str = "features", label: str = "label",
                  n_blocks: int | None = None, pairs: bool = False,
                  names: DataFrame | None = None) -> ColumnBlocks:
    """Cut a wide table into at least ``n_blocks`` column blocks; with ``pairs``
    the pairwise products follow the features."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    src = df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"))
    n, p0 = src.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if not n:
        raise ValueError("no rows to fit")
    p = p0 * (p0 + 1) // 2 if pairs else p0
    if n > max(p + 1, REDUCED_ROWS) and p <= REDUCED_MOST:
        return _reduced_blocks(src, n, p, p0, n_blocks, pairs, names)
    if n > MOST_SAMPLES:
        raise ValueError(f"{n} samples: column blocks are for wide tables")
    wide = max(int(n_blocks or 1), -(-8 * n * p // BLOCK_BYTES), 1)
    edges = [p * k // min(wide, p) for k in range(min(wide, p) + 1)]
    tiles, _ = written(spark, src.mapInArrow(_tile_fn(edges, p0, pairs), _TILES), "column-tiles")
    y = sorted((r["chunk"], bytes(r["cells"])) for r in
               tiles.where("block = -1").select("chunk", "cells").collect())
    blocks = (tiles.where("block >= 0").repartition(len(edges) - 1, "block").groupBy("block")
              .applyInArrow(_assemble, "block int, a binary")
              .persist(StorageLevel.MEMORY_AND_DISK))
    return ColumnBlocks(blocks, edges, np.frombuffer(b"".join(c for _, c in y), "<f8"), names, n)


def _reduced_blocks(src: DataFrame, n: int, p: int, p0: int, n_blocks: int | None, pairs: bool,
                    names: DataFrame | None) -> ColumnBlocks:
    """Column blocks of the p + 1 rows that have the second moments of the table."""
    wide = min(max(int(n_blocks or 1), -(-8 * (p + 1) * p // BLOCK_BYTES)), p)
    edges = [p * k // wide for k in range(wide + 1)]
    rows = moments(src, "features", "label", width=p0, pairs=pairs)
    # one group: the p moment rows, bounded by the columns
    cells, _ = written(src.sparkSession, rows.select(F.lit(0).alias("all"), "i", "g", "c", "yy")
                       .groupBy("all").applyInArrow(_reduced_fn(edges), "block int, a binary"),
                       "column-blocks")
    aside = {r["block"]: np.frombuffer(bytes(r["a"]), "<f8")
             for r in cells.where("block < 0").collect()}
    blocks = (cells.where("block >= 0").repartitionByRange(wide, "block")
              .persist(StorageLevel.MEMORY_AND_DISK))
    return ColumnBlocks(blocks, edges, aside[-1], names, n, aside[-2])


def descend(A: np.ndarray, v: np.ndarray, x: np.ndarray, lam: float, tol: float = 1e-10,
            most: int = 1000) -> np.ndarray:
    """Minimise ``½‖Aᵀx − v‖² + λ‖x‖₁`` (A: columns × n) from ``x``, by coordinate
    descent on the columns that are non-zero or break optimality."""
    x, size = x.copy(), np.einsum("ij,ij->i", A, A)
    on = np.flatnonzero(x)
    r = v - x[on] @ A[on]
    for _ in range(most):
        active = np.flatnonzero(((x != 0) | (np.abs(A @ r) > lam * (1 + 1e-12))) & (size > 0))
        moved = 0.0
        for _ in range(most):
            step = 0.0
            for i in active.tolist():
                old, g = x[i], A[i] @ r + size[i] * x[i]
                x[i] = math.copysign(max(abs(g) - lam, 0.0), g) / size[i]
                if x[i] != old:
                    r -= (x[i] - old) * A[i]
                    step = max(step, abs(x[i] - old) * math.sqrt(size[i]))
            moved = max(moved, step)
            if step < tol:
                break
        if moved < tol:
            break
    return x


def _round_fn(x: np.ndarray, shared: np.ndarray, lam: float, edges: list[int]):
    """New coefficients of the blocks of a partition, and their Σ A_j x_j."""
    p, n = edges[-1], len(shared)

    def run(batches):
        v, count = np.zeros(p + n), 0
        for rb in batches:
            for k, cell in zip(rb.column("block").to_pylist(), rb.column("a")):
                A = np.frombuffer(cell.as_buffer(), "<f8").reshape(-1, n)
                at = slice(edges[k], edges[k + 1])
                old = x[at]
                on = np.flatnonzero(old)
                new = descend(A, old[on] @ A[on] + shared, old, lam)
                v[at] = new
                on = np.flatnonzero(new)
                v[p:] += new[on] @ A[on]
                count += 1
        yield pa.RecordBatch.from_arrays(
            [_list_array(v[None, :]), pa.array([count], pa.int64())], names=["v", "nb"])
    return run


@dataclass
class SharingFit:
    coef: np.ndarray
    iterations: int
    converged: bool
    seconds: float
    problem: ColumnBlocks


def fit_sharing(problem: ColumnBlocks, lam: float, rho: float = 1.0, max_iter: int = 1000,
                abs_tol: float = 1e-6, rel_tol: float = 1e-6) -> SharingFit:
    """Rounds over the column blocks until both residuals are small."""
    t0 = time.time()
    b, N, p, n = problem.b, problem.n_blocks, problem.p, problem.n
    x, m, z, u = np.zeros(p), np.zeros(len(b)), np.zeros(len(b)), np.zeros(len(b))
    ok, j = False, 0
    for j in range(1, max_iter + 1):
        v, _ = added(problem.blocks.mapInArrow(
            _round_fn(x, z - m - u, lam / rho, problem.edges), "v array<double>, nb long"), N)
        x, m = v[:p], v[p:] / N
        old, z = z, (b + rho * (m + u)) / (N + rho)
        u = u + m - z
        eps = math.sqrt(n) * abs_tol
        size = np.linalg.norm
        ok = bool(math.sqrt(N) * size(m - z) < eps + rel_tol * math.sqrt(N) * max(size(m), size(z))
                  and rho * math.sqrt(N) * size(z - old)
                  < eps + rel_tol * rho * math.sqrt(N) * size(u))
        if ok:
            break
    return SharingFit(x, j, ok, time.time() - t0, problem)


def optimality(problem: ColumnBlocks, coef: np.ndarray, lam: float, tol: float) -> DataFrame:
    """``(idx, coef, xty, grad, kkt_ok)`` per feature, from the column blocks."""
    b, edges, xty = problem.b, problem.edges, problem.xty
    v, _ = added(problem.blocks.mapInArrow(_fitted_fn(coef, edges, len(b)),
                                           "v array<double>, nb long"), problem.n_blocks)
    r = b - v

    def run(batches):
        for rb in batches:
            for k, cell in zip(rb.column("block").to_pylist(), rb.column("a")):
                A = np.frombuffer(cell.as_buffer(), "<f8").reshape(-1, len(b))
                at = np.arange(edges[k], edges[k + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(coef[at]),
                     pa.array(A @ b if xty is None else xty[at]),
                     pa.array(A @ r)], names=["idx", "coef", "xty", "grad"])

    out = problem.blocks.mapInArrow(run, "idx int, coef double, xty double, grad double")
    on = F.abs(F.col("grad") - lam * F.signum("coef")) <= tol
    return out.withColumn("kkt_ok", F.when(F.col("coef") != 0, on).otherwise(
        F.abs("grad") <= lam + tol))


def _fitted_fn(x: np.ndarray, edges: list[int], n: int):
    def run(batches):
        total, count = np.zeros(n), 0
        for rb in batches:
            for k, cell in zip(rb.column("block").to_pylist(), rb.column("a")):
                A = np.frombuffer(cell.as_buffer(), "<f8").reshape(-1, n)
                total += x[edges[k]:edges[k + 1]] @ A
                count += 1
        yield pa.RecordBatch.from_arrays(
            [_list_array(total[None, :]), pa.array([count], pa.int64())], names=["v", "nb"])
    return run

"""L1-penalised least squares by consensus ADMM over row blocks.

Problem: minimise ``½‖Ax − b‖² + λ‖x‖₁`` (no intercept, no scaling). Rows are
split into N blocks; block i keeps a local copy x_i, a scaled dual u_i, and
the consensus vector z is soft-thresholded from their means::

    x_i ← (A_iᵀA_i + ρI)⁻¹ (A_iᵀb_i + ρ(z − u_i))
    z   ← S_{λ/(ρN)}(x̄ + ū)
    u_i ← u_i + x_i − z

Stopping rule (evaluated with the iterate *before* the update, as in the
original method): stop when ``r < ε_pri`` and ``s < ε_dual`` with
``r = sqrt(Σ‖x_i − z‖²)``, ``s = ρ√N‖z − z_old‖``,
``ε_pri = √(pN)·abs + rel·max(sqrt(Σ‖x_i‖²), √N‖z‖)`` and
``ε_dual = √(pN)·abs + rel·sqrt(Σ‖u_i‖²)``.

Spark layout:

* The raw table is read **once**: :func:`prepare` builds the block moments
  (see :mod:`.moments`) and writes the block statistics to the checkpoint
  folder, so a lost executor never re-reads the raw data.
* A narrow map adds each block's *eigen-factor*: rows B and values s with
  ``A_iᵀA_i = Bᵀ diag(s) B`` (dense) or ``A_iᵀA_i = BᵀB, BBᵀ = diag(s)`` (fat).
  One decomposition answers every ρ and gives ``zᵀA_iᵀA_i z`` as well. Factors
  are binary columns, hash-partitioned by block and cached, in partitions of at
  most about ``FACTOR_PART_BYTES``. Blocks of pair products have the rows of the
  features as their factor (:class:`PairRows`): neither products nor what is
  made of them are stored or moved.
* A block's iterate is a function of a saved iterate and the z of the rounds
  since. A round *replays* those rounds in the task that holds the factor, in
  one ``mapInArrow`` step that applies the pending u-update, takes every norm
  the stopping rule needs and solves for x_i, for all penalties in lockstep.
  Only sums leave it: neither iterates nor factors are moved or copied. The
  iterates that a fit begins with are formed there too, unless they are given.
* The partitions' sums are added on the executors, in levels
  (:func:`.reduction.added`) until a bounded number of rows is left.
* A fit of many fat blocks starts from the optimum of their summed moments
  instead of zeros (:func:`summed_start`): the number of rounds does not grow
  with that of the blocks, and the rounds confirm the start or correct it.
* Every ``checkpoint_every`` rounds the iterates are written, partitioned like
  the factors and cached, which bounds the replay and the lineage; a superseded
  checkpoint is deleted. Both sides of the join are partitioned by block, so no
  round has an exchange of either, at any size.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace
from typing import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast, checkpoint_dir, checkpointed, delete_path
from .moments import _list_array, _upper_rows, full_from_upper_rows, hash_blocks, moments
from .reduction import added

_LIST = pa.list_(pa.float64())


# ---------------------------------------------------------------- helpers


def soft_threshold_np(a: np.ndarray, kappa: float) -> np.ndarray:
    """S_κ(a) with strict inequalities; exact zeros elsewhere."""
    out = np.zeros_like(a)
    hi = a > kappa
    lo = a < -kappa
    out[hi] = a[hi] - kappa
    out[lo] = a[lo] + kappa
    return out


def _mat(col: pa.Array, rows: int, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)


# ---------------------------------------------------------------- pair products


def pair_base(p: int) -> int:
    """The features whose pairwise products make p columns with them."""
    return (math.isqrt(8 * p + 1) - 1) // 2


def _pair_columns_t(x: np.ndarray) -> np.ndarray:
    """Columns [x, x_k·x_j (k<j)] of rows x, as rows."""
    k, j = np.triu_indices(x.shape[1], 1)
    x = np.ascontiguousarray(x.T)
    return np.concatenate([x, x[k] * x[j]])


@dataclass
class PairRows:
    """Rows ``x`` (blocks × r × p₀) that stand for A = [x, x_k·x_j (k<j)]. With C the
    upper triangle of a vector's product part, a row times the vector is
    ``x·(v + Cᵀx)``, so products with A are products of small matrices: A, p₀/2
    times as wide as x, is only formed to take ``inv``, (AAᵀ + ρI)⁻¹, of a block."""

    x: np.ndarray
    inv: np.ndarray | None = None

    @classmethod
    def solving(cls, x: np.ndarray, rho: float) -> "PairRows":
        S = np.stack([A.T @ A for A in map(_pair_columns_t, x)])
        return cls(x, np.linalg.inv(S + rho * np.eye(x.shape[1])))

    def dot(self, V: np.ndarray) -> np.ndarray:
        """``V Aᵀ`` (blocks × K × r) of V, K×p or blocks × K × p."""
        p0 = self.x.shape[-1]
        k, j = np.triu_indices(p0, 1)
        C = np.zeros((*V.shape[:-1], p0, p0))
        C[..., k, j] = V[..., p0:]
        x = self.x[:, None]
        return ((x @ C + V[..., None, :p0]) * x).sum(axis=-1)

    def back(self, T: np.ndarray) -> np.ndarray:
        """``T A`` (blocks × K × p) of T, blocks × K × r."""
        k, j = np.triu_indices(self.x.shape[-1], 1)
        x = self.x[:, None]
        Q = np.swapaxes(x, 2, 3) @ (T[..., None] * x)
        return np.concatenate([T @ self.x, Q[..., k, j]], axis=-1)


def _dot(V: np.ndarray, B) -> np.ndarray:
    return B.dot(V) if isinstance(B, PairRows) else V @ np.swapaxes(B, 1, 2)


def _back(T: np.ndarray, B) -> np.ndarray:
    return B.back(T) if isinstance(B, PairRows) else T @ B


def _fat_row(col: pa.Array, r: int, p: int, pairs: bool):
    """The rows of one fat block, as one block for :func:`_dot` and :func:`_back`."""
    a = _row_values(col, r)
    return PairRows(a.reshape(1, -1, pair_base(p))) if pairs else a.reshape(1, -1, p)


# ---------------------------------------------------------------- problem


@dataclass
class LassoProblem:
    """Per-block sufficient statistics and factors of one (features, response)
    table.

    ``blocks``: ``block_id, g (flat A_iᵀA_i), q0 (A_iᵀb_i), n, yy, tr`` —
    written to the checkpoint folder, the only thing kept from the data scan.
    ``factors``: ``block_id, b, s, q0`` (see the module text), derived from
    ``blocks`` by a narrow map (recomputed from the checkpoint if lost); the
    same for every ρ. With ``pairs`` the blocks hold rows of the features whose
    products are meant, and those are the factors: ``block_id, b, q0``.
    ``xty``/``yy``/``n`` are totals kept on the driver (p numbers).
    """

    factors: DataFrame
    blocks: DataFrame
    p: int
    n_blocks: int
    rho: float
    xty: np.ndarray
    yy: float
    n: int
    trace: float
    names: DataFrame | None = None
    fat: bool = False
    partitions: int = 1
    pairs: bool = False

    @property
    def cells(self) -> list[str]:
        return ["block_id", "b", "q0"] if self.pairs else ["block_id", "b", "s", "q0"]

    def with_rho(self, rho: float | str) -> "LassoProblem":
        """The same problem for another ρ: the decomposition serves every ρ."""
        rho_v = _resolve_rho(rho, self.trace, self.p, self.n_blocks,
                             self.n if self.fat else None)
        return self if rho_v == self.rho else replace(self, rho=rho_v)

    def release(self) -> None:
        """Drop the cached factor rows (the checkpointed statistics stay)."""
        self.factors.unpersist()

    def rows(self, *columns: str) -> DataFrame:
        """``a``, the rows of fat blocks, or ``g``, with other columns of the blocks.
        Those of pair products are the factors, in the partitions of these."""
        if self.pairs:
            return self.factors.select(F.col("b").alias("a"), *columns)
        return self.blocks.select("a" if self.fat else "g", *columns)

    @property
    def moments(self) -> DataFrame:
        """Row form ``(block_id, i, g, c)`` of the block statistics."""
        if self.fat:
            raise ValueError("fat blocks keep their rows, not a Gram matrix")
        p = self.p
        return self.blocks.select(
            "block_id", F.posexplode("q0").alias("i", "c"), "g", "n", "yy").select(
            "block_id", "i", F.slice("g", F.col("i") * p + 1, p).alias("g"), "c", "n", "yy")


def _assemble(pdf):
    """p moment rows of one block → one row with the flat Gram matrix."""
    import pandas as pd

    pdf = pdf.sort_values("i")
    G = full_from_upper_rows(pdf["g"].to_numpy(), len(pdf))
    return pd.DataFrame({
        "block_id": [pdf["block_id"].iloc[0]], "g": [G.reshape(-1)],
        "q0": [pdf["c"].to_numpy(dtype=np.float64)],
        "n": [int(pdf["n"].iloc[0])], "yy": [float(pdf["yy"].iloc[0])],
        "tr": [float(np.trace(G))]})


_BLOCK_SCHEMA = T.StructType([
    T.StructField("block_id", T.LongType()),
    T.StructField("g", T.ArrayType(T.DoubleType())),
    T.StructField("q0", T.ArrayType(T.DoubleType())),
    T.StructField("n", T.LongType()),
    T.StructField("yy", T.DoubleType()),
    T.StructField("tr", T.DoubleType())])

_FACTOR_SCHEMA = T.StructType([
    T.StructField("block_id", T.LongType()),
    T.StructField("b", T.BinaryType()),
    T.StructField("s", T.BinaryType()),
    T.StructField("q0", T.ArrayType(T.DoubleType()))])


def eigen_factor(G: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows B and values s of a Gram matrix: ``G = Bᵀ diag(s) B``, ``BBᵀ = I``."""
    s, V = np.linalg.eigh(G)
    return np.ascontiguousarray(V.T), np.maximum(s, 0.0)


def eigen_rows(A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows B and values s of a block of rows: ``AᵀA = BᵀB``, ``BBᵀ = diag(s)``."""
    s, W = np.linalg.eigh(A @ A.T)
    return np.ascontiguousarray(W.T @ A), np.maximum(s, 0.0)


def _factor_fn(p: int, fat: bool):
    def factor(batches):
        for rb in (part for batch in batches for part in _few(batch, p)):
            col = rb.schema.get_field_index
            rows = rb.column(col("a" if fat else "g"))
            found = [(eigen_rows if fat else eigen_factor)(
                _row_values(rows, r).reshape(-1, p)) for r in range(rb.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [rb.column(col("block_id")),
                 pa.array([b.tobytes() for b, _ in found], pa.binary()),
                 pa.array([v.tobytes() for _, v in found], pa.binary()),
                 rb.column(col("q0"))], names=["block_id", "b", "s", "q0"])

    return factor


# block ids whose spread over partitions is looked at, at most
_SPREAD_BLOCKS = 4096
# bytes of the factors of one partition, about: what a task holds as one Arrow batch
FACTOR_PART_BYTES = 16 << 20
# not serialized: that takes chunks of 1 MB, each of which fills two 1 MB regions of a
# heap of up to 4 GB, so a store that counts as half full has the heap full
KEPT = StorageLevel.MEMORY_AND_DISK_DESER


def _factor_bytes(p: int, rows: float, fat: bool, pairs: bool) -> float:
    """Of a block's factor; ``rows`` per block."""
    if pairs:
        return 8 * (rows * pair_base(p) + p)
    return 8 * ((rows if fat else p) * (p + 1) + p)


def _partitions_for(blocks: DataFrame, n_blocks: int, wide: int, nbytes: float = 0) -> int:
    """Partitions of the factor table, for ``wide`` cores. With few blocks a hash
    puts some of them together; of the counts near the number of cores (or
    blocks) the one whose fullest partition, times its waves of tasks, is
    smallest is taken. Blocks of more than ``FACTOR_PART_BYTES`` for each of so
    many partitions (``nbytes``: of a block) have as many as they fill."""
    parts = max(1, min(n_blocks, wide))
    full = min(n_blocks, math.ceil(n_blocks * nbytes / FACTOR_PART_BYTES))
    if full > 4 * parts:
        return full
    if n_blocks > _SPREAD_BLOCKS:
        return 4 * parts
    ids = np.array([r[0] for r in blocks.select(F.hash("block_id")).collect()], dtype=np.int64)
    load = {k: int(np.bincount(ids % k).max(initial=0))
            for k in range(max(parts, full), 4 * parts + 1)}
    return min(load, key=lambda k: (load[k] * -(-k // wide), k))


def _factor(blocks: DataFrame, p: int, fat: bool, parts: int, pairs: bool = False) -> DataFrame:
    """The eigen-factor per block, partitioned by block and kept in memory."""
    if pairs:
        factors = blocks.select("block_id", F.col("a").alias("b"), "q0")
    else:
        factors = blocks.select("block_id", "a" if fat else "g", "q0").mapInArrow(
            _factor_fn(p, fat), _FACTOR_SCHEMA)
    return factors.repartition(parts, "block_id").persist(KEPT)


# ---------------------------------------------------------------- fat blocks
#
# When a block has fewer rows than features (p > n_i: wide genotype tables,
# interaction features) the p×p factor is wasteful or impossible. A fat block
# keeps its rows A_i (n_i × p); with A_iA_iᵀ = W diag(s) Wᵀ and B = WᵀA_i the
# x-update uses the matrix inversion lemma:
#     (A_iᵀA_i + ρI)⁻¹ q = (q − Bᵀ diag(1/(s+ρ)) B q) / ρ
# so a round costs O(n_i·p) per block instead of O(p²), and no p×p matrix is
# ever formed. Blocks are runs of at most ``rows_per_block`` consecutive rows
# of a reading task, so their size is bounded whatever the key distribution.
# Blocks of pair products keep the rows of the features, 2/p₀ of the numbers of B; a
# task takes (A_iA_iᵀ + ρI)⁻¹ anew, in about the time that B would take to reach it.

# dense blocks of a fit that asks for no number
DEFAULT_BLOCKS = 4
# widest design that ``mode="auto"`` fits with dense blocks: a factor of 32 MB
DENSE_MAX_FEATURES = 2048
# bytes of one fat block's rows, from which the rows per block are derived
FAT_BLOCK_BYTES = 16 << 20
FAT_BLOCK_ROWS = 512
# blocks of one value of ``block_col`` that a task builds, about
_HOT_BLOCKS = 16

_FAT_BLOCK_SCHEMA = T.StructType([
    T.StructField("block_id", T.LongType()),
    T.StructField("a", T.ArrayType(T.DoubleType())),
    T.StructField("ni", T.LongType()),
    T.StructField("q0", T.ArrayType(T.DoubleType())),
    T.StructField("n", T.LongType()),
    T.StructField("yy", T.DoubleType()),
    T.StructField("tr", T.DoubleType())])

def _row_values(col: pa.Array, r: int) -> np.ndarray:
    return col[r].values.to_numpy(zero_copy_only=False)


def fat_rows(p: int) -> int:
    """Rows of a fat block of p features: ``FAT_BLOCK_ROWS``, or fewer so that
    its cell stays within ``FAT_BLOCK_BYTES``."""
    return max(1, min(FAT_BLOCK_ROWS, FAT_BLOCK_BYTES // (8 * max(p, 1))))


def _fat_blocks_fn(rows_per_block: int | None, pairs: bool):
    """Blocks of consecutive rows of one key, built in the reading task."""

    def block(pid, seq, parts):
        A = np.concatenate([x for x, _ in parts])
        b = np.concatenate([y for _, y in parts])
        if pairs:
            wide = A.shape[1] * (A.shape[1] + 1) // 2
            q0 = PairRows(A[None]).back(b[None, None])[0, 0]
            tr = PairRows((A * A)[None]).dot(np.ones((1, wide))).sum()
        else:
            q0, tr = A.T @ b, (A * A).sum()
        return pa.RecordBatch.from_pydict({
            "block_id": pa.array([(pid << 31) + seq], pa.int64()),
            "a": pa.array([A.reshape(-1)], _LIST), "ni": pa.array([len(b)], pa.int64()),
            "q0": pa.array([q0], _LIST), "n": pa.array([len(b)], pa.int64()),
            "yy": pa.array([float(b @ b)]), "tr": pa.array([float(tr)])})

    def run(batches):
        from pyspark import TaskContext

        pid, seq, p, limit = TaskContext.get().partitionId(), 0, None, None
        open_: dict = {}                # key -> (rows so far, parts)
        held = 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            feats, y = rb.column(1), rb.column(2)
            lens = feats.value_lengths().to_numpy(zero_copy_only=False)
            if p is None:
                p = int(lens[0])
                wide = p * (p + 1) // 2 if pairs else p
                limit = int(rows_per_block or fat_rows(wide))
            flat = feats.flatten()
            if feats.null_count or flat.null_count or y.null_count or (lens != p).any():
                raise ValueError(f"null or ragged rows: expected {p} features and a response")
            X = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)
            y = y.to_numpy(zero_copy_only=False).astype(np.float64)
            keys = rb.column(0).to_numpy(zero_copy_only=False)
            for key in dict.fromkeys(keys.tolist()):
                at = np.flatnonzero(keys == key)
                while len(at):
                    have, parts = open_.get(key, (0, []))
                    take, at = at[:limit - have], at[limit - have:]
                    open_[key] = (have + len(take), [*parts, (X[take], y[take])])
                    held += len(take)
                    if have + len(take) == limit:
                        yield block(pid, seq, open_.pop(key)[1])
                        seq, held = seq + 1, held - limit
            while held * p * 8 > 4 * FAT_BLOCK_BYTES and len(open_) > 1:
                # many keys in one task: close the fullest
                key = max(open_, key=lambda k: open_[k][0])
                have, parts = open_.pop(key)
                yield block(pid, seq, parts)
                seq, held = seq + 1, held - have
        for have, parts in open_.values():
            yield block(pid, seq, parts)
            seq += 1

    return run


def fat_block_statistics(df: DataFrame, features: str = "features", label: str = "label",
                         rows_per_block: int | None = None,
                         block_col: Column | str | None = None,
                         pairs: bool = False) -> DataFrame:
    """One row per fat block: ``block_id, a (flat rows), ni, q0, n, yy, tr``.

    A block is a run of at most ``rows_per_block`` (default :func:`fat_rows`)
    rows of one reading task, built in that task: the rows are not shuffled,
    and a retried task builds its blocks anew as a whole. With ``block_col`` the
    rows are dealt to tasks by its value and rows of different values never
    share a block; a value of more rows has several. With ``pairs`` the blocks
    are those of the features and all their pairwise products: ``q0`` and ``tr``
    have these, ``a`` the features only (:class:`PairRows`).
    """
    key = F.lit(0) if block_col is None else (
        F.col(block_col) if isinstance(block_col, str) else block_col)
    src = df.select(key.cast("long").alias("key"), F.col(features).alias("features"),
                    F.col(label).cast("double").alias("label"))
    if block_col is not None:
        # asked for: rows of a value lie together, those of a hot value in as many
        # tasks as it has blocks' worth of rows
        part = _HOT_BLOCKS * (rows_per_block or FAT_BLOCK_ROWS)
        size = src.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
        hot = size.where("parts > 1").withColumnRenamed("key", "hot_key")
        src = src.join(hot, F.col("key").eqNullSafe(F.col("hot_key")), "left").select(
            "key", "features", "label",
            F.coalesce(F.pmod(F.xxhash64("features", "label"), F.col("parts")),
                       F.lit(0)).alias("part")).repartition("key", "part").drop("part")
    return src.mapInArrow(_fat_blocks_fn(rows_per_block, pairs), _FAT_BLOCK_SCHEMA)


def _resolve_rho(rho, trace: float, p: int, n_blocks: int, n: int | None = None) -> float:
    if isinstance(rho, str):
        if rho != "auto":
            raise ValueError("rho must be a positive number or 'auto'")
        # mean diagonal of A_iᵀA_i: trace/p/N. For fat blocks (given n) the
        # trace is spread over min(p, rows per block) directions instead —
        # A_iᵀA_i has no more non-zero eigenvalues than rows
        rank = min(p, n / n_blocks) if n and n_blocks else p
        val = trace / rank / n_blocks if rank and n_blocks else 0.0
        return val if val > 0 else 1.0
    rho = float(rho)
    if not rho > 0:
        raise ValueError("rho must be positive")
    return rho


def block_statistics(df: DataFrame, features: str = "features", label: str = "label",
                     n_blocks: int | None = None,
                     block_col: Column | str | None = None) -> DataFrame:
    """One row per block: ``block_id, g, q0, n, yy, tr`` (lazy)."""
    spark = df.sparkSession
    if block_col is None:
        # the same blocks however the rows are partitioned
        block = hash_blocks(F.struct(F.col(features), F.col(label)),
                            int(n_blocks or DEFAULT_BLOCKS))
    else:
        block = F.col(block_col) if isinstance(block_col, str) else block_col
    src = df.select(block.cast("long").alias("block_id"),
                    F.col(features).alias("features"),
                    F.col(label).cast("double").alias("label"))
    mom = moments(src, "features", "label", keys=["block_id"])
    # group size = p moment rows of one block (bounded by the feature count)
    return mom.groupBy("block_id").applyInPandas(_assemble, _BLOCK_SCHEMA)


def prepare(df: DataFrame, features: str = "features", label: str = "label",
            n_blocks: int | None = None, block_col: Column | str | None = None,
            rho: float | str = 1.0, names: DataFrame | None = None,
            mode: str = "dense", rows_per_block: int | None = None,
            pairs: bool = False) -> LassoProblem:
    """Scan the table once and build the per-block factors.

    ``mode="dense"`` (default): each block is reduced to its p×p Gram matrix
    (any number of rows per block; p up to a few thousand). ``mode="fat"``:
    blocks of at most ``rows_per_block`` rows keep their rows and a small
    n_i×n_i factor (for p ≫ rows per block, e.g. interaction features; with
    ``pairs`` the model has all pairwise products too, which are never stored).
    The layout sets N and with it every iterate, so it is the caller's choice;
    ``mode="auto"`` derives it from the memory of a dense factor (dense up to
    ``DENSE_MAX_FEATURES`` features). ``LassoProblem.fat`` and ``n_blocks``
    record what was used.

    ``block_col`` overrides the block assignment (any integer column or
    expression); ``n_blocks`` (``DEFAULT_BLOCKS`` if not given) asks for that many
    dense blocks by a hash of the row: the same blocks, and the same iterates,
    for every partitioning. ``block_col=moments.partition_blocks(n)`` follows the
    reading task instead, the cheapest to reduce.
    """
    checkpoint_dir(df.sparkSession)
    if mode == "auto":
        first = df.select(F.size(features).alias("p")).first()
        if first is None:
            raise ValueError("no rows to fit")
        p = first["p"] * (first["p"] + 1) // 2 if pairs else first["p"]
        mode = "dense" if p <= DENSE_MAX_FEATURES and not pairs else "fat"
    if mode == "fat":
        stats = fat_block_statistics(df, features, label, rows_per_block, block_col, pairs)
    elif mode == "dense":
        if pairs:
            raise ValueError("pairs needs mode='fat'; else use features.interactions")
        stats = block_statistics(df, features, label, n_blocks, block_col)
    else:
        raise ValueError("mode must be 'dense', 'fat' or 'auto'")
    # the one write of the preparation: a lost executor never re-reads data
    return problem_from_blocks(stats.checkpoint(eager=True), rho, names, pairs)


def problem_from_blocks(blocks: DataFrame, rho: float | str = 1.0,
                        names: DataFrame | None = None, pairs: bool = False) -> LassoProblem:
    """LassoProblem from a block-statistics table (``block_id, g, q0, n, yy,
    tr``), e.g. one accumulated by :mod:`sparselm.streaming`, or from fat blocks
    (``pairs`` as they were built). The table should already be materialised
    (checkpointed or written)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    tot = blocks.agg(vector_to_array(Summarizer.sum(array_to_vector("q0"))).alias("c"),
                     F.count(F.lit(1)).alias("N"), F.sum("n").alias("n"),
                     F.sum("yy").alias("yy"), F.sum("tr").alias("tr")).first()
    if not tot["N"]:
        raise ValueError("no rows to fit")
    xty = np.asarray(tot["c"], dtype=np.float64)
    p, n_eff = len(xty), int(tot["N"])  # blocks that actually hold rows
    if names is not None and names.count() != p:
        raise ValueError(f"the dictionary has {names.count()} names, the rows {p} features")
    fat = "a" in blocks.columns
    # fat blocks: spread the trace over the rows of a block (see _resolve_rho)
    rho_v = _resolve_rho(rho, float(tot["tr"]), p, n_eff, int(tot["n"]) if fat else None)
    # a decomposition per block, by all cores; then one task per partition a round
    wide = blocks.sparkSession.sparkContext.defaultParallelism
    have = blocks.rdd.getNumPartitions()
    spread = blocks
    if have < min(n_eff, wide) and not pairs:
        spread = blocks.repartition(min(n_eff, wide))
    parts = _partitions_for(blocks, n_eff, wide,
                            _factor_bytes(p, int(tot["n"]) / n_eff, fat, pairs))
    return LassoProblem(_factor(spread, p, fat, parts, pairs), blocks, p, n_eff, rho_v, xty,
                        float(tot["yy"]), int(tot["n"]), float(tot["tr"]), names, fat, parts,
                        pairs)


def merge_block_statistics(parts: DataFrame) -> DataFrame:
    """Sum several block-statistics tables (same block ids add up)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return parts.groupBy("block_id").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"),
        vector_to_array(Summarizer.sum(array_to_vector("q0"))).alias("q0"),
        F.sum("n").alias("n"), F.sum("yy").alias("yy"), F.sum("tr").alias("tr"))


def gradient_check(problem: "LassoProblem", z: np.ndarray, lam: float,
                   tol: float = 1e-6) -> DataFrame:
    """Optimality (KKT) of a coefficient vector, per feature.

    ``grad = Aᵀb − AᵀA z`` is summed over blocks Spark-side; ``kkt_ok`` holds
    when ``|grad − λ·sign(z)| ≤ tol`` for non-zero z and ``|grad| ≤ λ + tol``
    for zero z. Output ``(idx, coef, grad, kkt_ok)``.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    p, zz = problem.p, np.asarray(z, dtype=np.float64)

    fat, pairs = problem.fat, problem.pairs

    def part(batches):
        total = np.zeros(p)
        for rb in batches:
            rows = rb.num_rows
            total += _mat(rb.column(rb.schema.get_field_index("q0")), rows, p).sum(axis=0)
            if fat:
                for r in range(rows):
                    A = _fat_row(rb.column(rb.schema.get_field_index("a")), r, p, pairs)
                    total -= _back(_dot(zz[None, None], A), A)[0, 0]
            else:
                G = _mat(rb.column(rb.schema.get_field_index("g")), rows, p * p)
                total -= (G.reshape(rows, p, p) @ zz).sum(axis=0)
        yield pa.RecordBatch.from_arrays([_list_array(total[None, :])], names=["r"])

    grad = (problem.rows("q0").mapInArrow(part, "r array<double>")
            .agg(vector_to_array(Summarizer.sum(array_to_vector("r"))).alias("grad")))
    zarr = F.array(*[F.lit(float(v)) for v in zz])
    out = grad.select(F.posexplode("grad").alias("idx", "grad"))
    zi = F.element_at(zarr, F.col("idx") + 1)
    ok = (F.when(zi != 0, F.abs(F.col("grad") - F.lit(float(lam)) * F.signum(zi)) <= tol)
          .otherwise(F.abs(F.col("grad")) <= float(lam) + tol))
    return out.select(F.col("idx").cast("int"), zi.alias("coef"), "grad", ok.alias("kkt_ok"))


# ---------------------------------------------------------------- state


@dataclass
class AdmmState:
    """Resumable iterate: per-block ``(x, u_prev)`` and the consensus z.

    The u-update of the last finished iteration is still pending (it is
    fused into the next step), so ``u = u_prev + x − z`` per block.
    """

    blocks: DataFrame      # block_id, x, u
    z: np.ndarray
    rho: float
    iteration: int = 0


def initial_state(problem: LassoProblem) -> AdmmState:
    zero = F.array_repeat(F.lit(0.0), problem.p)
    blocks = problem.factors.select("block_id", zero.alias("x"), zero.alias("u"))
    return AdmmState(blocks, np.zeros(problem.p), problem.rho, 0)


# Iterate rows: one per block, for K fits run in lockstep as K×p row-major
# arrays: x = x^{k+1}, u = u^k, and the last round's input xp = x^k, up = u^{k-1}
# (the resumable state of a fit that stops there).
_DARR = T.ArrayType(T.DoubleType())
_STATE = ("x", "u", "xp", "up")
_STATE_SCHEMA = T.StructType([T.StructField("block_id", T.LongType()),
                              *[T.StructField(c, _DARR) for c in _STATE]])
_SUM_SCHEMA = T.StructType([T.StructField("v", _DARR), T.StructField("nb", T.LongType())])


def _solve(B, s, Q, rho: float, fat: bool) -> np.ndarray:
    """(A_iᵀA_i + ρI)⁻¹ q for every block and fit: B rows×r×p and s rows×1×r, or pair
    rows for this ρ; Q rows×K×p."""
    T_ = _dot(Q, B)
    T_ = T_ @ B.inv if isinstance(B, PairRows) else T_ / (s + rho)
    return (Q - _back(T_, B)) / rho if fat else _back(T_, B)


# numbers of the vectors (p a block and fit) that a task works on at a time
_FEW_CELLS = 1 << 17


def _few(rb: pa.RecordBatch, width: int):
    """A batch of blocks in slices whose vectors of ``width`` numbers are few."""
    step = max(1, _FEW_CELLS // max(width, 1))
    for lo in range(0, rb.num_rows, step):
        yield rb.slice(lo, step)


def _same_size(rb: pa.RecordBatch, width: int):
    """Runs of few blocks with factors of one size, so that they stack."""
    b = rb.column("b")
    size = b.value_lengths() if pa.types.is_list(b.type) else pc.binary_length(b)
    size = size.to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(size)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), rb.num_rows]):
        yield from _few(rb.slice(lo, hi - lo), width)


def _stacked(col: pa.Array, rows: int) -> np.ndarray:
    """Binary cells of one size as a rows × n matrix, without a copy."""
    _, off, data = col.buffers()
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(off, dtype=kind)[col.offset:col.offset + rows + 1]
    return np.frombuffer(data, dtype="<f8", offset=int(off[0]),
                         count=int(off[-1] - off[0]) // 8).reshape(rows, -1)


def _first_iterates(Z: np.ndarray, rest: bool, B, q0: np.ndarray, rho: float) -> tuple:
    """``X, Up, XP, UP`` of blocks where a fit begins: zeros or, with ``rest``, at rest
    on Z: ``x = z, u = (A_iᵀb_i − A_iᵀA_i z)/ρ``."""
    X = np.broadcast_to(Z, (len(q0), *Z.shape))
    U = (q0 - _back(_dot(X, B), B)) / rho if rest else np.zeros(X.shape)
    return X, U, X, U


def _replay_fn(rounds: list, rho: float, p: int, fat: bool, sums: bool, pairs: bool = False,
               begin: tuple | None = None):
    """Replay ``rounds`` (Z, active, solve) on the blocks of a partition, K fits
    at once, from their saved iterates or, with ``begin`` (Z, rest), from
    :func:`_first_iterates`.

    A round, per block and fit: apply the pending u-update
    ``u^k = u^{k-1} + x^k − z^k`` and solve
    ``x^{k+1} = (A_iᵀA_i + ρI)⁻¹(A_iᵀb_i + ρ(z^k − u^k))``. Fits that are not
    ``active`` keep their state. With ``sums`` the output is one row: Σx^{k+1},
    Σu^k, and per fit Σ‖x^k‖², Σ‖u^k‖², Σ‖x^k − z^k‖², Σ zᵀA_iᵀA_i z of the last
    round; else the iterates after it.
    """
    K = rounds[-1][0].shape[0]

    def run(batches: Iterable[pa.RecordBatch]):
        sx, su, tot, nb = np.zeros((K, p)), np.zeros((K, p)), np.zeros((4, K)), 0
        for rb in (part for batch in batches for part in _same_size(batch, K * p)):
            rows = rb.num_rows
            if pairs:
                b = rb.column("b").flatten().to_numpy(zero_copy_only=False)
                B, s = PairRows.solving(b.reshape(rows, -1, pair_base(p)), rho), None
            else:
                B = _stacked(rb.column("b"), rows).reshape(rows, -1, p)
                s = _stacked(rb.column("s"), rows)[:, None, :]
            q0 = _mat(rb.column("q0"), rows, p)[:, None, :]
            X, Up, XP, UP = _first_iterates(*begin, B, q0, rho) if begin else (
                _mat(rb.column(c), rows, K * p).reshape(rows, K, p) for c in _STATE)
            for Z, active, solve in rounds:
                U = Up + X - Z                                   # pending u-update
                Xn = _solve(B, s, q0 + rho * (Z - U), rho, fat) if solve else X
                last = X
                if active.all():
                    X, Up, XP, UP = Xn, U, X, Up
                else:
                    act = active[None, :, None]
                    X, Up, XP, UP = (np.where(act, Xn, X), np.where(act, U, Up),
                                     np.where(act, X, XP), np.where(act, Up, UP))
            if not sums:
                yield pa.RecordBatch.from_arrays(
                    [rb.column("block_id"), *[_list_array(M.reshape(rows, K * p))
                                              for M in (X, Up, XP, UP)]],
                    names=["block_id", *_STATE])
                continue
            sx += Xn.sum(axis=0)
            su += U.sum(axis=0)
            D, BZ = last - Z, _dot(Z, B)
            tot += [np.einsum("rkj,rkj->k", last, last), np.einsum("rkj,rkj->k", U, U),
                    np.einsum("rkj,rkj->k", D, D),
                    np.einsum("rkj,rkj->k", BZ if fat else BZ * s, BZ)]
            nb += rows
        if sums:
            v = np.concatenate([sx.ravel(), su.ravel(), tot.ravel()])
            yield pa.RecordBatch.from_arrays(
                [_list_array(v[None, :]), pa.array([nb], pa.int64())], names=["v", "nb"])

    return run


def _round_sums(joined: DataFrame, rounds: list, problem: LassoProblem,
                begin: tuple | None) -> dict:
    """Sums of the last of ``rounds``; a bounded number of rows reaches the driver."""
    K, p = rounds[-1][0].shape[0], problem.p
    v, nb = added(joined.mapInArrow(_replay_fn(rounds, problem.rho, p, problem.fat, True,
                                               problem.pairs, begin), _SUM_SCHEMA),
                  problem.partitions)
    tot = v[2 * K * p:].reshape(4, K)
    return {"sx": v[:K * p].reshape(K, p), "su": v[K * p:2 * K * p].reshape(K, p),
            **dict(zip(("xx", "uu", "r2", "zgz"), tot)), "nb": nb}


# fewest fat blocks, and most features (moments of 128 MB), of a summed start
SUMMED_START_BLOCKS = 16
SUMMED_START_FEATURES = 4096


def _block_moments_fn(p: int, pairs: bool):
    """Rows ``(i, g)`` of Σ A_iᵀA_i over the blocks of a partition, from the diagonal on."""
    width = pair_base(p) if pairs else p

    def run(batches):
        G = np.zeros((p, p))
        step = max(1, _MOMENT_CELLS // p)
        for rb in batches:
            cell = rb.column(0)
            flat = cell.flatten().to_numpy(zero_copy_only=False) if pairs else np.concatenate(
                [np.frombuffer(b.as_buffer(), "<f8") for b in cell]) if len(cell) else []
            rows = np.reshape(flat, (-1, width))
            for lo in range(0, len(rows), step):
                A = _pair_columns_t(rows[lo:lo + step]) if pairs else rows[lo:lo + step].T
                G += A @ A.T
        upper = _upper_rows(G)
        for lo in range(0, p, 256):
            k = min(256, p - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(lo, lo + k), pa.int32()), upper.slice(lo, k)], names=["i", "g"])
    return run


# cells of the rows whose moments a task adds at a time
_MOMENT_CELLS = 1 << 20


def summed_start(problem: LassoProblem, lams) -> np.ndarray:
    """K×p: the optimum of every penalty, from the moments of all fat blocks. They
    are added on the executors, from one partial sum per core; one task gets p
    rows of up to p numbers, whatever the number of rows, and the driver the
    coefficients."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from .local_fit import support_fit

    p, c, lams = problem.p, problem.xty, list(lams)

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        G = np.empty((p, p))
        for i, g in enumerate(g for ch in t.column("g").chunks for g in ch):
            G[i, i:] = G[i:, i] = g.values.to_numpy()
        z = np.stack([support_fit(G, c, lam) for lam in lams])
        return pa.table({"k": pa.array(range(len(z)), pa.int32()), "z": _list_array(z)})

    rows = problem.factors.select("b")
    wide = rows.sparkSession.sparkContext.defaultParallelism
    total = (rows.coalesce(wide).mapInArrow(_block_moments_fn(p, problem.pairs),
                                            "i int, g array<double>")
             .groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")))
    rows = total.select(F.lit(0).alias("all"), "i", "g").groupBy("all").applyInArrow(
        solve, "k int, z array<double>").collect()
    return np.array([r["z"] for r in sorted(rows, key=lambda r: r["k"])])


# ---------------------------------------------------------------- fit


@dataclass
class LassoFit:
    coef: np.ndarray
    iterations: int
    converged: bool
    lam: float
    rho: float
    seconds: float
    history_rows: list
    state: AdmmState
    xbar: np.ndarray
    ubar: np.ndarray
    problem: LassoProblem = field(repr=False)
    round_seconds: list = field(default_factory=list)

    # -- DataFrame views -------------------------------------------------
    def coefficients(self, nonzero_only: bool = False) -> DataFrame:
        """``(idx, name, coef)``; names from the dictionary if known."""
        spark = self.problem.factors.sparkSession
        rows = [(i, float(v) + 0.0) for i, v in enumerate(self.coef)
                if (v != 0 or not nonzero_only)]
        df = spark.createDataFrame(rows, "idx int, coef double")
        if self.problem.names is not None:
            df = df.join(bounded_broadcast(self.problem.names.select("idx", "name"),
                                           self.problem.p), "idx", "left")
        else:
            df = df.withColumn("name", F.concat(F.lit("x"), F.col("idx").cast("string")))
        return df.select("idx", "name", "coef")

    def history(self) -> DataFrame:
        spark = self.problem.factors.sparkSession
        return spark.createDataFrame(self.history_rows, HISTORY_SCHEMA)

    def timings(self) -> DataFrame:
        """``(iter, seconds)``: wall-clock time of every round's job."""
        spark = self.problem.factors.sparkSession
        return spark.createDataFrame([(int(i), float(t)) for i, t in self.round_seconds],
                                     "iter int, seconds double")

    def final_state(self) -> DataFrame:
        """``(idx, name, z, xbar, ubar)``."""
        spark = self.problem.factors.sparkSession
        rows = [(i, float(self.coef[i]) + 0.0, float(self.xbar[i]), float(self.ubar[i]))
                for i in range(self.problem.p)]
        df = spark.createDataFrame(rows, "idx int, z double, xbar double, ubar double")
        if self.problem.names is not None:
            df = df.join(bounded_broadcast(self.problem.names.select("idx", "name"),
                                           self.problem.p), "idx", "left")
        else:
            df = df.withColumn("name", F.concat(F.lit("x"), F.col("idx").cast("string")))
        return df.select("idx", "name", "z", "xbar", "ubar")

    def objective(self) -> float:
        return objective(self.problem, self.coef, self.lam)

    def nnz(self) -> int:
        return int(np.count_nonzero(self.coef))


HISTORY_SCHEMA = ("iter int, resid_primal double, eps_primal double, resid_dual double, "
                  "eps_dual double, objective double")


def objective(problem: LassoProblem, z: np.ndarray, lam: float, zgz: float | None = None) -> float:
    """½‖Az − b‖² + λ‖z‖₁ from the sufficient statistics."""
    if zgz is None:
        zgz = _zgz(problem, z)
    return float(0.5 * zgz - float(z @ problem.xty) + 0.5 * problem.yy
                 + lam * float(np.abs(z).sum()))


def _zgz(problem: LassoProblem, z: np.ndarray) -> float:
    return float(_zgz_many(problem, np.asarray(z, dtype=np.float64)[None, :])[0])


def _zgz_many(problem: LassoProblem, Z: np.ndarray) -> np.ndarray:
    """``z_kᵀ AᵀA z_k`` for each row of Z, summed over blocks in one job."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    ZZ, p = np.asarray(Z, dtype=np.float64), problem.p

    fat, pairs = problem.fat, problem.pairs

    def part(batches):
        for rb in batches:
            if fat:
                out = np.stack([
                    (_dot(ZZ[None], _fat_row(rb.column(0), r, p, pairs))[0] ** 2).sum(axis=1)
                    for r in range(rb.num_rows)]) if rb.num_rows else np.zeros((0, len(ZZ)))
            else:
                G = _mat(rb.column(rb.schema.get_field_index("g")), rb.num_rows, p * p)
                out = np.einsum("kj,rjl,kl->rk", ZZ, G.reshape(rb.num_rows, p, p), ZZ)
            yield pa.RecordBatch.from_arrays([_list_array(out)], names=["zgz"])

    row = (problem.rows().mapInArrow(part, "zgz array<double>")
           .agg(vector_to_array(Summarizer.sum(array_to_vector("zgz"))).alias("s")).first())
    return np.asarray(row["s"] if row["s"] is not None else np.zeros(len(ZZ)))


def fit(problem: LassoProblem, lam: float, max_iter: int = 1000, abs_tol: float = 1e-6,
        rel_tol: float = 1e-6, init: AdmmState | None = None, checkpoint_every: int = 20,
        logs: bool = False) -> LassoFit:
    """Run consensus ADMM to convergence (or ``max_iter`` rounds).

    ``init`` resumes from an earlier fit's state (warm start). When that state
    was built for a different ρ the scaled dual is rescaled by ρ_old/ρ_new.
    """
    return fit_many(problem, [lam], max_iter, abs_tol, rel_tol, init, checkpoint_every,
                    logs)[0]


def fit_many(problem: LassoProblem, lams, max_iter: int = 1000, abs_tol: float = 1e-6,
             rel_tol: float = 1e-6, init: AdmmState | None = None,
             checkpoint_every: int = 20, logs: bool = False) -> list[LassoFit]:
    """Fit several penalties in lockstep: one Spark stage per round for all.

    Each fit follows exactly the iterate sequence of a single :func:`fit`
    (same start, same stopping rule) and stops on its own; a stopped fit's
    state is frozen in the block rows. A grid therefore costs as many rounds
    as its slowest member instead of the sum. ``init`` (one state) starts
    every fit.
    """
    lams = [float(v) for v in lams]
    if not lams or min(lams) < 0:
        raise ValueError("lambda must be non-negative")
    t0 = time.time()
    spark = problem.factors.sparkSession
    K, p, N, rho = len(lams), problem.p, problem.n_blocks, problem.rho
    state = init or initial_state(problem)
    parts = problem.partitions

    def tile(c):
        return F.flatten(F.array_repeat(F.col(c), K)).alias(c) if K > 1 else F.col(c)

    def placed(iterates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(factors with iterates, the cached iterates): both sides lie by block
        on the same partitions, so the join moves neither."""
        held = iterates.repartition(parts, "block_id").persist(KEPT)
        return problem.factors.join(held.hint("shuffle_hash"), "block_id").select(
            *problem.cells, *_STATE), held

    Z = np.tile(np.asarray(state.z, dtype=np.float64), (K, 1))
    begin = None
    if init is None:                # formed where the factors are: nothing to place
        rest = problem.fat and N >= SUMMED_START_BLOCKS and p <= SUMMED_START_FEATURES
        if rest:
            Z = summed_start(problem, lams)
        begin = (Z.copy(), rest)
        joined, held = problem.factors.select(*problem.cells), None
    else:
        blocks = state.blocks
        if state.rho != rho:
            blocks = blocks.select("block_id", "x", F.transform(
                "u", lambda v: v * F.lit(state.rho / rho)).alias("u"))
        joined, held = placed(blocks.select("block_id", tile("x"), tile("u")).select(
            "block_id", "x", "u", F.col("x").alias("xp"), F.col("u").alias("up")))
    kappa = np.array(lams) / (rho * N)
    sqrt_pn = math.sqrt(p * N)
    history: list = [[] for _ in range(K)]
    pending: list = [None] * K       # iteration k-1 quantities waiting for r_{k-1}
    done = np.zeros(K, dtype=bool)
    converged = [False] * K
    it_done = [0] * K
    spent: list = []                 # (round, seconds)
    xbar, ubar = np.zeros((K, p)), np.zeros((K, p))
    saved_path = None                # the last checkpoint of the iterates
    rounds: list = []                # (z, active, solve) since the saved iterates
    for j in range(max_iter + 1):
        last = j == max_iter
        active = ~done
        rounds.append((Z.copy(), active, not last))
        t_round = time.time()
        agg = _round_sums(joined, rounds, problem, begin)
        spent.append((state.iteration + j, time.time() - t_round))
        for k in np.flatnonzero(active):
            pend = pending[k]
            if pend is not None:
                r_prev = math.sqrt(max(agg["r2"][k], 0.0))
                obj = objective(problem, Z[k], lams[k], agg["zgz"][k])
                row = (int(pend["iter"]), float(r_prev), float(pend["eps_pri"]), float(pend["s"]),
                       float(pend["eps_dual"]), float(obj))
                history[k].append(row)
                if logs:
                    print(("lam=%g " % lams[k]) + "iter %4d  r=%.3e  eps_pri=%.3e  s=%.3e  "
                          "eps_dual=%.3e  obj=%.6f" % row)
                it_done[k] = pend["iter"] + 1 - state.iteration
                xbar[k], ubar[k] = pend["xbar"], pend["ubar"]
                if r_prev < pend["eps_pri"] and pend["s"] < pend["eps_dual"]:
                    converged[k] = True
                    done[k] = True           # state frozen as this round's input
                    continue
            if last:
                done[k] = True
                continue
            # finish iteration j on the driver: tolerances, z-update, dual residual
            eps_dual = sqrt_pn * abs_tol + rel_tol * math.sqrt(max(agg["uu"][k], 0.0))
            eps_pri = sqrt_pn * abs_tol + rel_tol * max(math.sqrt(max(agg["xx"][k], 0.0)),
                                                        math.sqrt(N) * float(np.linalg.norm(Z[k])))
            xb, ub = agg["sx"][k] / N, agg["su"][k] / N
            z_new = soft_threshold_np(xb + ub, kappa[k])
            s = rho * math.sqrt(N) * float(np.linalg.norm(z_new - Z[k]))
            pending[k] = {"iter": state.iteration + j, "eps_pri": eps_pri, "eps_dual": eps_dual,
                          "s": s, "xbar": xb, "ubar": ub}
            Z[k] = z_new
        if done.all():
            break
        if checkpoint_every and (j + 1) % checkpoint_every == 0:
            before, gone = saved_path, held
            iterates, saved_path = checkpointed(joined.mapInArrow(_replay_fn(
                rounds, rho, p, problem.fat, False, problem.pairs, begin), _STATE_SCHEMA))
            joined, held = placed(iterates)
            rounds, begin = [], None
            if gone is not None:
                gone.unpersist()
            if before:
                delete_path(spark, before)
    # write the resumable states (frozen xp/up of every fit), release caches
    final = joined.mapInArrow(_replay_fn(
        rounds, rho, p, problem.fat, False, problem.pairs, begin), _STATE_SCHEMA) \
        .select("block_id", "xp", "up").checkpoint(eager=True)
    if held is not None:
        held.unpersist()
    if saved_path:
        delete_path(spark, saved_path)
    seconds = time.time() - t0
    fits = []
    for k in range(K):
        blk = final.select("block_id", F.slice("xp", k * p + 1, p).alias("x"),
                           F.slice("up", k * p + 1, p).alias("u"))
        st = AdmmState(blk, Z[k].copy(), rho, state.iteration + it_done[k])
        fits.append(LassoFit(Z[k].copy(), it_done[k], converged[k], lams[k], rho, seconds,
                             history[k], st, xbar[k].copy(), ubar[k].copy(), problem, spent))
    return fits


def lambda_max(problem: LassoProblem) -> float:
    """Smallest λ for which the solution is all zeros: max |Aᵀb|."""
    return float(np.abs(problem.xty).max()) if problem.p else 0.0

"""Column expressions over dense vectors stored as ``array<double>``.

All helpers but :func:`pair_products` return built-in Spark expressions
(higher-order array functions), which run JVM-side inside the generated stage.
The products are p² numbers a row: those are formed by numpy on Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double_array(col, lenient: bool = False) -> Column:
    """Cast every element to double. Strict mode fails on a bad cell (ANSI
    cast), lenient mode yields null for it (``try_cast``)."""
    if lenient:
        return F.transform(_c(col), lambda v: v.try_cast("double"))
    return F.transform(_c(col), lambda v: v.cast("double"))


def dot(a, b) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def vadd(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vsub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vscale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def sq_norm(a) -> Column:
    """Squared Euclidean norm of an array column."""
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v)


def soft_threshold(a, kappa) -> Column:
    """Scalar soft threshold S_kappa(a): a-k if a>k, a+k if a<-k, else 0.

    The inequalities are strict, as in the proximal step of the fit; the
    trailing ``+ 0.0`` turns a negative zero into zero.
    """
    a = _c(a)
    k = kappa if isinstance(kappa, Column) else F.lit(float(kappa))
    return (F.when(a > k, a - k).when(a < -k, a + k)
            .otherwise(F.lit(0.0)) + F.lit(0.0))


def soft_threshold_array(a, kappa) -> Column:
    """Element-wise soft threshold of an array column."""
    k = kappa if isinstance(kappa, Column) else F.lit(float(kappa))
    return F.transform(_c(a), lambda v: soft_threshold(v, k))


def _pair_batch(a):
    """Products of every row of an Arrow batch of vectors, row lengths as they
    come; a null vector gives null, a null factor a null product."""
    import numpy as np
    import pyarrow as pa

    size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = a.flatten()
    known = None if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    wide = size * (size - 1) // 2
    out = np.empty(int(wide.sum()))
    valid = np.ones(len(out), dtype=bool)
    off, at = np.cumsum(size) - size, np.cumsum(wide) - wide
    for n in np.unique(size).tolist():
        k, j = np.triu_indices(n, 1)
        for rows in np.array_split(np.flatnonzero(size == n),
                                   max(1, int((size == n).sum() * len(k) >> 22))):
            here = off[rows][:, None]
            there = (at[rows][:, None] + np.arange(len(k))).ravel()
            out[there] = (x[here + k] * x[here + j]).ravel()
            if known is not None:
                valid[there] = (known[here + k] & known[here + j]).ravel()
    ends = np.append(0, np.cumsum(wide))
    values = pa.array(out, mask=None if known is None else ~valid)
    return pa.ListArray.from_arrays(
        pa.array(ends.astype(np.int32)), values,
        mask=None if not a.null_count else a.is_null())


def pair_products(a, n=None) -> Column:
    """All products a[k]*a[j] for k<j, in order (0,1),(0,2)...(n-2,n-1).

    Numpy on Arrow batches of the vectors, inside the scan stage and without any
    join. Vectors of fewer than two elements have none. With ``n`` the vectors
    must have that many.
    """
    a = _c(a)
    if n is not None and int(n) < 2:
        return F.array().cast("array<double>")
    if n is not None:
        a = F.when(a.isNull() | (F.size(a) == int(n)), a).otherwise(F.raise_error(
            F.concat(F.lit(f"expected {int(n)} features, found "), F.size(a).cast("string"))))

    @F.arrow_udf("array<double>")
    def products(v: pa.Array) -> pa.Array:
        return _pair_batch(v)

    return products(a)


def pair_index(n: int) -> Column:
    """Struct array ``(k, j)`` matching the order of :func:`pair_products`."""
    if int(n) < 2:
        return F.array().cast("array<struct<k:int,j:int>>")
    nn = F.lit(int(n))
    return F.flatten(F.transform(
        F.sequence(F.lit(0), nn - 2),
        lambda k: F.transform(F.sequence(k + 1, nn - 1),
                              lambda j: F.struct(k.alias("k"), j.alias("j")))))


def drop_positions(a, positions) -> Column:
    """Remove the given 0-based positions from an array, keeping order."""
    pos = sorted({int(p) for p in positions})
    if not pos:
        return _c(a)
    banned = F.array(*[F.lit(p) for p in pos])
    return F.filter(_c(a), lambda v, i: ~F.array_contains(banned, i))

"""Sums of vectors over the partitions of a table, added on the executors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# partial rows that one task, or the driver, adds up
FAN_IN = 64


def _add(batches):
    total, n = None, 0
    for rb in batches:
        if rb.num_rows:
            v = rb.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, -1)
            total = v.sum(axis=0) if total is None else total + v.sum(axis=0)
            n += int(rb.column("nb").to_numpy().sum())
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total)),
             pa.array([n], pa.int64())], names=["v", "nb"])


def added(parts: DataFrame, partitions: int) -> tuple[np.ndarray, int]:
    """``(v, nb)``: the sum of the vectors ``v`` and counts ``nb`` of a table with
    about one row per partition. Beyond ``FAN_IN`` partitions the partial sums
    are added on the executors, in levels; no task, and not the driver, ever
    adds more than about ``FAN_IN`` rows, whatever the partition count."""
    while partitions > FAN_IN:
        partitions = max(-(-partitions // FAN_IN), math.isqrt(partitions - 1) + 1
                         if partitions <= FAN_IN ** 2 else 1)
        parts = parts.repartition(partitions).mapInArrow(_add, parts.schema)
    rows = parts.collect()
    return np.sum([np.asarray(r["v"]) for r in rows], axis=0), sum(r["nb"] for r in rows)

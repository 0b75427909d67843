"""Embedding near-duplicates by p-stable hashing (operator 5).

Equal vectors of a label form a *class*; copies go no further.  A class's unit
vector is projected on random Gaussian directions, shifted and quantised to
cells of width ``CELL``; ``DIRECTIONS`` cells make one key and there are
``TABLES`` independent keys.  Classes that share a key of a table meet; pairs
are made distinct and confirmed by the exact cosine in double precision, of
whole vectors.

Recall: at cosine 0.98 (distance 0.2) one cell agrees with probability 0.90,
one of 16-cell keys with 0.19, so a pair is missed by all 64 tables with
probability 2e-6; closer pairs less.  ``tests/llm`` measures it by brute force.

Vectors that are null, zero, hold a null or a non-finite component, or have a
null label link with nothing: their component is their own id.  Vectors of
other dimensions never link.  Repeated rows are copies of each other and count
as links.  A null id is never a component label unless nothing else is.  Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselm.llm.components import connected_components
from sparselm.llm.tables import saved, table
from sparselm.llm.textblock import mix

TABLES, DIRECTIONS, CELL = 64, 16, 1.6
LEAST_COSINE = 0.98
_ROWS = 4096


def _usable(v) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())


def _class_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class key of every vector: label and components, as 128 bits."""
    import xxhash

    for b in batches:
        keys = []
        for label, v in zip(b.column("label").to_pylist(), b.column("vector")):
            if label is None or not v.is_valid or v.values.null_count:
                keys.append(None)
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0     # no -0
            keys.append(xxhash.xxh3_128_digest(f"{label}|{len(x)}|".encode() + x.tobytes())
                        if _usable(x) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("label"), b.column("vector"), pa.array(keys, pa.binary())],
            names=["id", "label", "vector", "cls"])


def _units(vectors: pa.Array) -> np.ndarray:
    x = vectors.values.to_numpy(zero_copy_only=False)
    off = vectors.offsets.to_numpy()
    x = x[off[0]:off[-1]].astype(np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _same_length(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of rows whose vectors have one dimension."""
    size = pa.compute.list_value_length(b.column(column)).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        part = b.filter(pa.array(size == n))
        for lo in range(0, part.num_rows, _ROWS):
            yield part.slice(lo, _ROWS)


def _key_pass(tables: int, directions: int, cell: float, seed: int):
    drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _same_length(whole, "vector"):
                u = _units(b.column("vector"))
                dim = u.shape[1]
                if dim not in drawn:
                    rng = np.random.Generator(np.random.PCG64([seed, dim]))
                    drawn[dim] = (rng.standard_normal((dim, tables * directions)),
                                  rng.uniform(0, cell, tables * directions))
                a, shift = drawn[dim]
                cells = np.floor((u @ a + shift) / cell).astype(np.int64).view(np.uint64)
                cells = cells.reshape(len(u), tables, directions)
                key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64),
                                      (len(u), tables)).copy()
                for j in range(directions):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls"), b.column("label"), pa.ListArray.from_arrays(
                        pa.array(np.arange(len(u) + 1, dtype=np.int32) * tables),
                        pa.array(key.view(np.int64).ravel()))],
                    names=["cls", "label", "keys"])
    return run


def _cosine_pass(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = [pa.compute.list_value_length(whole.column(c)).to_numpy(zero_copy_only=False)
                    for c in ("va", "vb")]
            whole = whole.filter(pa.array(size[0] == size[1]))
            for b in _same_length(whole, "va"):
                cos = (_units(b.column("va")) * _units(b.column("vb"))).sum(axis=1)
                at = pa.array(cos >= least)
                yield pa.RecordBatch.from_arrays(
                    [b.column("a").filter(at), b.column("b").filter(at),
                     pa.array(cos).filter(at)], names=["a", "b", "cosine"])
    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label",
                 least: float = LEAST_COSINE, tables: int = TABLES,
                 directions: int = DIRECTIONS, cell: float = CELL,
                 seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(per row: id, n_links, component_id, kept; confirmed class pairs: a, b,
    cosine).  Class membership is by equality of label and vector."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                         F.col(vector_col).alias("vector"))
    rows = saved(spark, src.mapInArrow(_class_pass, T.StructType(
        [*src.schema.fields, T.StructField("cls", T.BinaryType())])), "ev-rows")
    classes = saved(spark, rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"),
        F.first("vector").alias("vector")), "ev-classes")
    keyed = classes.select("cls", "label", "vector").mapInArrow(
        _key_pass(tables, directions, cell, seed),
        T.StructType([T.StructField("cls", T.BinaryType()), src.schema["label"],
                      T.StructField("keys", T.ArrayType(T.LongType()))]))
    keyed = keyed.select("cls", "label", F.explode("keys").alias("key"))
    shared = keyed.groupBy("label", "key").agg(F.count("*").alias("size")).where("size > 1")
    keyed = saved(spark, keyed.join(shared.drop("size"), ["label", "key"]), "ev-keys")
    pairs = keyed.select("label", "key", F.col("cls").alias("a")).join(
        keyed.select("label", "key", F.col("cls").alias("b")), ["label", "key"]).where(
        "a < b").select("a", "b").distinct()
    known = classes.select("cls", "vector")
    pairs = pairs.join(known.select(F.col("cls").alias("a"), F.col("vector").alias("va")), "a") \
        .join(known.select(F.col("cls").alias("b"), F.col("vector").alias("vb")), "b")
    links = saved(spark, pairs.mapInArrow(
        _cosine_pass(least), "a binary, b binary, cosine double"), "ev-links")

    size = classes.select("cls", "n")
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(
        links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    direct = both.join(size.select(F.col("cls").alias("other"), F.col("n").alias("m")),
                       "other").groupBy("cls").agg(F.sum("m").alias("others"))
    comp = connected_components(spark, links.select("a", "b")).withColumnRenamed("id", "cls")
    label = classes.select("cls", "low", "n").join(comp, "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    lows = label.groupBy("component").agg(F.min("low").alias("component_id"))
    label = label.join(lows, "component").join(direct, "cls", "left").select(
        "cls", "component_id",
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    cid = F.coalesce("component_id", "id")
    out = rows.select("id", "cls").join(label, "cls", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        cid.alias("component_id"), F.col("id").eqNullSafe(cid).alias("kept"))
    return out, links


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = near_vectors(spark, table(spark, sf_dir, "embeddings"))
    return out.withColumnRenamed("id", "vec_id")

"""Feature-table reshaping: transposition, column removal, pairwise
interaction features and the combined-matrix text rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import drop_positions, pair_index, pair_products
from ..session import bounded_broadcast
from ..sources.text import TAB, LabeledMatrix, MarkerMajor


# cells of one assembled block of samples, and cells a scanning task sorts into tiles
TILE_CELLS = 1 << 20


def _tile_fn(width: int):
    """Cells of a scan as tiles: per ``width`` samples the markers seen so far."""
    def tiles(parts):
        sample = np.concatenate([b.column("sample_idx").to_numpy() for b in parts]).astype(np.int64)
        marker = np.concatenate([b.column("marker_idx").to_numpy() for b in parts])
        value = pa.concat_arrays([b.column("value") for b in parts])
        block = sample // width
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else order
        ends = pa.array(np.append(cut, len(order)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[order[cut]]),
             pa.ListArray.from_arrays(ends, pa.array(sample[order])),
             pa.ListArray.from_arrays(ends, pa.array(marker[order].astype(np.int32))),
             pa.ListArray.from_arrays(ends, value.take(pa.array(order)))],
            names=["block", "samples", "markers", "cells"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            parts.append(b)
            held += b.num_rows
            if held >= TILE_CELLS:
                yield tiles(parts)
                parts, held = [], 0
        if held:
            yield tiles(parts)

    return run


def _assembled(p: int):
    """Tiles of a block of samples, and their names → one row per sample."""
    schema = pa.schema([("sample_idx", pa.int64()), ("sample_id", pa.string()),
                        ("features", pa.list_(pa.float64()))])

    def run(tiles: pa.Table, names: pa.Table) -> pa.Table:
        def flat(c):
            return pa.concat_arrays([x.flatten() for x in tiles.column(c).chunks])

        if not tiles.num_rows:
            return schema.empty_table()
        sample, marker = flat("samples").to_numpy(), flat("markers").to_numpy()
        order = np.lexsort((marker, sample))
        sample, marker = sample[order], marker[order]
        at = np.flatnonzero(np.r_[True, np.diff(sample) != 0])
        found = np.diff(np.append(at, len(sample)))
        again = (np.diff(sample) == 0) & (np.diff(marker) == 0)
        if (found != p).any() or again.any():
            bad = sample[at[np.flatnonzero(found != p)[0]]] if (found != p).any() \
                else sample[np.flatnonzero(again)[0]]
            raise ValueError(f"a sample does not have one cell per marker: {bad}")
        values = pa.ListArray.from_arrays(pa.array(np.append(at, len(sample)).astype(np.int32)),
                                          flat("cells").take(pa.array(order)))
        rows = pa.table({"sample_idx": pa.array(sample[at]), "place": pa.array(np.arange(len(at)))})
        named = names.select(["sample_idx", "sample_id"]).join(rows, "sample_idx", join_type="inner")
        return pa.Table.from_arrays(
            [named.column("sample_idx"), named.column("sample_id"),
             values.take(named.column("place").combine_chunks())], schema=schema)

    return run


def transpose_long(mm: MarkerMajor) -> LabeledMatrix:
    """Marker-major long form → sample-major matrix.

    The scan sorts its cells into tiles (a run of markers × ``width`` samples,
    arrays of numbers), which are shuffled once, by block of samples; a block of
    some ``TILE_CELLS`` cells is assembled in one task and meets its sample
    names there, so neither cells nor assembled rows move again. A sample with
    a missing or a repeated cell raises: its row would have shifted values. A
    sample without a name, or without any cell, has no row.
    """
    p = mm.markers.count()
    width = max(1, TILE_CELLS // max(p, 1))
    tiles = mm.long.select(F.col("sample_idx").cast("long").alias("sample_idx"), "marker_idx",
                           F.col("value").cast("double").alias("value")).mapInArrow(
        _tile_fn(width),
        "block long, samples array<long>, markers array<int>, cells array<double>")
    names = mm.samples.select(F.col("sample_idx").cast("long").alias("sample_idx"),
                              F.col("sample_id").cast("string").alias("sample_id"))
    names = names.withColumn("block", F.floor(F.col("sample_idx") / F.lit(width)).cast("long"))
    df = tiles.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(
        _assembled(p), "sample_idx long, sample_id string, features array<double>")
    names = mm.markers.select(F.col("marker_idx").alias("idx"), F.col("marker").alias("name"))
    return LabeledMatrix(df, names, "features")


def drop_features(m: LabeledMatrix, positions) -> LabeledMatrix:
    """Remove features by 0-based position; the dictionary is re-indexed."""
    pos = sorted({int(p) for p in positions})
    df = m.df.withColumn(m.vector_col, drop_positions(m.vector_col, pos))
    kept = m.names.where(~F.col("idx").isin(pos)) if pos else m.names
    shift = F.lit(0)
    for p in pos:
        shift = shift + F.when(F.col("idx") > p, 1).otherwise(0)
    names = kept.select((F.col("idx") - shift).cast("int").alias("idx"), "name")
    return LabeledMatrix(df, names, m.vector_col)


def interactions(m: LabeledMatrix, p: int | None = None, keep_main: bool = True,
                 out: str = "features") -> LabeledMatrix:
    """Pairwise products x_k·x_j for k<j, appended after the main effects.

    Order: (0,1), (0,2), …, (p−2, p−1); no squares; p(p+1)/2 features in
    total with the main effects. Computed per row from the array (no join,
    no shuffle). Names of products are ``a:b``.
    """
    if p is None:
        p = m.width()
    prods = pair_products(m.vector_col, p)
    vec = F.concat(F.col(m.vector_col), prods) if keep_main else prods
    df = m.df.withColumn(out, vec)
    if out != m.vector_col:
        df = df.drop(m.vector_col)
    base = m.names.select("idx", "name")
    # pair list generated per k in parallel: k from range(p), j from k+1..p-1
    pairs = (base.sparkSession.range(p).select(F.col("id").cast("int").alias("k"))
             .select("k", F.explode(F.sequence(F.col("k") + 1, F.lit(p - 1))).alias("j"))
             .where((F.col("j") > F.col("k")) & (F.col("j") < p)))
    a = base.select(F.col("idx").alias("k"), F.col("name").alias("a"))
    b = base.select(F.col("idx").alias("j"), F.col("name").alias("b"))
    # the dictionary has p rows: the broadcast is bounded by the feature count
    pair_names = (pairs.join(bounded_broadcast(a, p), "k").join(bounded_broadcast(b, p), "j")
                  .select((F.lit(p if keep_main else 0) + F.col("k") * (2 * p - F.col("k") - 1) / 2
                           + (F.col("j") - F.col("k") - 1)).cast("int").alias("idx"),
                          F.concat_ws(":", "a", "b").alias("name")))
    names = base.unionByName(pair_names) if keep_main else pair_names
    return LabeledMatrix(df, names, out)


def interactions_long(m: LabeledMatrix, p: int | None = None) -> DataFrame:
    """Long form of the products: ``(sample_id, k, j, value)``."""
    if p is None:
        p = m.width()
    return m.df.select("sample_id", F.posexplode(F.arrays_zip(
        pair_index(p).alias("kj"), pair_products(m.vector_col, p).alias("v"))).alias("pos", "e")) \
        .select("sample_id", F.col("e.kj.k").alias("k"), F.col("e.kj.j").alias("j"),
                F.col("e.v").alias("value"))


def combined_rows(features: DataFrame, traits: DataFrame, p: int,
                  key: str = "sample_id", features_col: str = "features",
                  traits_col: str = "traits") -> DataFrame:
    """Rows of the combined matrix: traits, main effects, pair products.

    Samples and traits are matched on ``key`` (the positional pairing of the
    original tool is available through :func:`..align.positional_join`).
    Trait cells are copied verbatim when the trait table carries its raw text
    (``<traits_col>_text``, see ``read_traits(keep_text=True)``), otherwise
    the parsed values are printed. Output ``(sample_id, value)`` where
    ``value`` is the tab-joined line; the one-marker case still ends its line
    (no product columns then).
    """
    j = features.join(traits, key)
    return j.select(key, combined_line(traits, p, features_col, traits_col).alias("value"))


def combined_line(traits: DataFrame, p: int, features_col: str = "features",
                  traits_col: str = "traits"):
    """The tab-joined combined-matrix line as a column expression."""
    text_col = traits_col + "_text"
    trait_cells = (F.col(text_col) if text_col in traits.columns
                   else F.transform(traits_col, lambda v: v.cast("string")))
    numbers = F.concat(F.col(features_col), pair_products(features_col, p))
    return F.concat_ws(TAB, F.concat(trait_cells,
                                     F.transform(numbers, lambda v: v.cast("string"))))

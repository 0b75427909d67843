"""Aligning feature and trait tables on sample id.

* :func:`join_samples` — inner equi-join on ``sample_id`` (unmatched ids are
  dropped, duplicated ids multiply, exactly like a relational inner join).
* :func:`alignment_report` — what that join dropped or multiplied, as one row.
* :func:`positional_join` — pair the i-th row of one table with the i-th row of
  another (ids ignored); position is a distributed row index.
* :func:`design` — pick the response (one trait) next to the features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, written
from ..sources.text import LINE_PLACE, LabeledMatrix


def with_row_index(df: DataFrame, name: str = "row_idx", order_by: list | None = None) -> DataFrame:
    """Add a dense 0-based row index in ``order_by`` order, or in scan order.

    Scan order is the order of :func:`..sources.text.read_lines` (file name,
    place in the file) when its position columns are there, else the order of
    partitions and of rows inside them.

    The ordered frame, each row tagged with its partition and its place there,
    is **written once** to the checkpoint folder; partition offsets and rows
    both come from that copy, so they always belong together (two runs of a
    plan may partition differently). Offsets are one row per partition (or split
    of a file); their broadcast is hinted only while their number is small.
    Raises if the result would not have as many rows as the input.
    """
    spark = df.sparkSession
    placed = all(c in df.columns for c in LINE_PLACE)
    cols = [c for c in df.columns if c not in LINE_PLACE]
    if order_by:
        df = df.orderBy(*order_by)
    local = F.monotonically_increasing_id()
    if placed and not order_by:
        # a split of a file is read by one task, in order
        group = [F.col(c).alias(f"_rix_{i}") for i, c in enumerate(LINE_PLACE)]
    else:
        group = [F.lit("").alias("_rix_0"), F.spark_partition_id().cast("long").alias("_rix_1")]
    tagged, _ = written(spark, df.select(*cols, *group, local.alias("_rix_mid")), "row-index")
    keys = ["_rix_0", "_rix_1"]
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rix_n"),
                                      F.min("_rix_mid").alias("_rix_first"),
                                      F.max("_rix_mid").alias("_rix_last"))
    # ids of a partition (or split) run without a gap
    whole, groups = parts.select(
        F.bool_and(F.col("_rix_last") - F.col("_rix_first") + 1 == F.col("_rix_n")),
        F.count(F.lit(1))).first()
    if whole is False:
        raise RuntimeError("row positions of a partition are not contiguous")
    offsets = parts.select(*keys, "_rix_first",
                           F.coalesce(F.sum("_rix_n").over(w), F.lit(0)).alias("_rix_off"))
    return (tagged.join(bounded_broadcast(offsets, groups), keys)
            .withColumn(name, F.col("_rix_off") + F.col("_rix_mid") - F.col("_rix_first"))
            .select(*cols, name))


def join_samples(left: DataFrame | LabeledMatrix, right: DataFrame | LabeledMatrix,
                 key: str = "sample_id") -> DataFrame:
    """Inner equi-join of a feature table and a trait table on the sample key.

    A plain relational join: Catalyst/AQE choose shuffle or broadcast from the
    measured sizes, and AQE splits skewed keys.
    """
    l = left.df if isinstance(left, LabeledMatrix) else left
    r = right.df if isinstance(right, LabeledMatrix) else right
    return l.join(r, key, "inner")


def alignment_report(left: DataFrame | LabeledMatrix, right: DataFrame | LabeledMatrix,
                     key: str = "sample_id", strict: bool = False) -> DataFrame:
    """One-row report of how the inner join on ``key`` behaves.

    Columns: ``left_rows, right_rows, joined_rows, left_only_rows,
    right_only_rows, left_dup_ids, right_dup_ids``. Both sides are first
    reduced to per-key counts (map-side combined, so a hot key costs one row),
    then the two count tables are outer-joined. ``strict=True`` raises when
    anything was dropped or duplicated.
    """
    l = left.df if isinstance(left, LabeledMatrix) else left
    r = right.df if isinstance(right, LabeledMatrix) else right
    lc = l.groupBy(key).agg(F.count(F.lit(1)).alias("lc"))
    rc = r.groupBy(key).agg(F.count(F.lit(1)).alias("rc"))
    j = lc.join(rc, key, "full_outer")
    rep = j.agg(
        F.coalesce(F.sum("lc"), F.lit(0)).cast("long").alias("left_rows"),
        F.coalesce(F.sum("rc"), F.lit(0)).cast("long").alias("right_rows"),
        F.coalesce(F.sum(F.col("lc") * F.col("rc")), F.lit(0)).cast("long").alias("joined_rows"),
        F.coalesce(F.sum(F.when(F.col("rc").isNull(), F.col("lc"))), F.lit(0)).cast("long")
        .alias("left_only_rows"),
        F.coalesce(F.sum(F.when(F.col("lc").isNull(), F.col("rc"))), F.lit(0)).cast("long")
        .alias("right_only_rows"),
        F.count(F.when(F.col("lc") > 1, 1)).cast("long").alias("left_dup_ids"),
        F.count(F.when(F.col("rc") > 1, 1)).cast("long").alias("right_dup_ids"))
    if strict:
        row = rep.first()
        bad = {k: row[k] for k in ("left_only_rows", "right_only_rows",
                                   "left_dup_ids", "right_dup_ids") if row[k]}
        if bad:
            raise ValueError(f"feature and trait tables do not match: {bad}")
    return rep


def positional_join(left: DataFrame, right: DataFrame,
                    left_order: list | None = None, right_order: list | None = None,
                    index: str = "pos") -> DataFrame:
    """Pair rows by position (i-th with i-th), ignoring ids.

    Surplus rows on either side are dropped (inner join on the position); the
    position comes from :func:`with_row_index`, so nothing is gathered on one
    task or on the driver.
    """
    li = with_row_index(left, index, left_order)
    ri = with_row_index(right, index, right_order)
    return li.join(ri, index, "inner")


def design(aligned: DataFrame, trait: int | str | Column | None = None,
           trait_names: DataFrame | None = None, traits_col: str = "traits",
           label_col: str = "label") -> DataFrame:
    """Select the response next to the features.

    ``trait=None`` takes the **last** trait (keyed layout); an ``int`` is a
    0-based position; a ``str`` is looked up in ``trait_names``; a Column is
    used as is. Extra traits are kept in ``traits`` and ignored by the fit.
    """
    if trait is None:
        y = F.element_at(traits_col, -1)
    elif isinstance(trait, Column):
        y = trait
    elif isinstance(trait, int):
        y = F.element_at(traits_col, trait + 1)
    else:
        if trait_names is None:
            raise ValueError("trait given by name needs the trait dictionary")
        hit = trait_names.where(F.col("name") == trait).select("idx").first()
        if hit is None:
            raise KeyError(trait)
        y = F.element_at(traits_col, int(hit["idx"]) + 1)
    return aligned.withColumn(label_col, y.cast("double"))

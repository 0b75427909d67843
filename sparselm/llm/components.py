"""Connected components of an edge table by alternating star contractions.

Every step is a grouped minimum (partial aggregation on the map side) joined
back to the edges with an ordinary equi-join that adaptive execution can split
at a hot vertex; neither edges nor components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselm.session import delete_path, written


def _large_star(e: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a vertex to the smallest one."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(low, "a")
            .select(F.col("m").alias("a"), "b").where("a < b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of a vertex, and itself, to the smallest."""
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    j = e.join(low, "b")
    return (j.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(j.select(F.col("m").alias("a"), "b")).where("a < b").distinct())


def connected_components(spark: SparkSession, edges: DataFrame,
                         max_rounds: int = 200) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b of one orderable
    type); component is the smallest id reachable.  Self-links and nulls are
    ignored."""
    e = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
         .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    e, path = written(spark, e, "cc-edges")
    for _ in range(max_rounds):
        before = path
        e, path = written(spark, _small_star(_large_star(e)), "cc-edges")
        delete_path(spark, before)
        # done when every vertex hangs on one root and no root hangs on another
        most = e.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None or most == 1 and e.select(F.col("a").alias("b")).join(
                e.select("b"), "b", "left_semi").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not converge")
    return (e.select(F.col("b").alias("id"), F.col("a").alias("component"))
            .union(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()))

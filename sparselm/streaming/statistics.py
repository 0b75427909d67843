"""Block statistics of a growing sample table, with Structured Streaming.

New sample-major TSV files dropped into a folder are parsed with the same
expressions as the batch scan. The stream is stateless: each micro-batch task
turns its rows into partial moments (``A_iᵀA_i`` rows, ``A_iᵀb_i``, ``n_i``,
``b_iᵀb_i`` — :func:`sparselm.operators.moments.partial_moments`) which the
Parquet file sink appends exactly once (the sink's commit log and the query's
checkpoint location track what was consumed and written). Summing the table per
block gives the statistics of every row seen so far, from which a fit starts
without rescanning any data. No state store, no Python callback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import admm
from ..operators.moments import partial_moments, partition_blocks
from ..sources.text import parse_sample_major


def stream_sample_major(spark: SparkSession, folder: str, header: str,
                        vector_col: str = "features", lenient: bool = False,
                        max_files_per_trigger: int | None = None):
    """Streaming scan of sample-major files arriving in ``folder``.

    A stream has no "first line", so the header text is given; every copy of
    it (one per file) is dropped. Returns a LabeledMatrix over a streaming
    DataFrame.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return parse_sample_major(reader.load(folder), vector_col, lenient, header=header)


def accumulate_block_statistics(samples: DataFrame, table_path: str, checkpoint_location: str,
                                features: str = "features", label: str = "label",
                                n_blocks: int | None = None,
                                available_now: bool = True) -> StreamingQuery:
    """Start a query appending every micro-batch's partial block moments.

    ``samples`` is a streaming DataFrame with ``features`` and ``label``.
    Blocks follow the micro-batch task (``partition id mod n_blocks``). With
    ``available_now`` the query processes what is there and stops.
    """
    n_blocks = int(n_blocks or samples.sparkSession.sparkContext.defaultParallelism)
    src = samples.select(partition_blocks(n_blocks).alias("block_id"),
                         F.col(features).alias("features"),
                         F.col(label).cast("double").alias("label"))
    parts = partial_moments(src, "features", "label", keys=["block_id"])
    writer = (parts.writeStream.format("parquet").outputMode("append")
              .option("path", table_path).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_block_statistics(spark: SparkSession, table_path: str) -> DataFrame:
    """Everything committed so far, summed per block: ``block_id, g, q0, n,
    yy, tr`` (the table a fit starts from)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = spark.read.parquet(table_path)
    mom = parts.groupBy("block_id", "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"),
        F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("yy").alias("yy"))
    # group size = p moment rows of one block (bounded by the feature count)
    return mom.groupBy("block_id").applyInPandas(admm._assemble, admm._BLOCK_SCHEMA)


def problem_from_stream(spark: SparkSession, table_path: str, rho: float | str = 1.0,
                        names: DataFrame | None = None) -> "admm.LassoProblem":
    """Fit-ready problem from everything accumulated so far."""
    from ..session import checkpoint_dir

    checkpoint_dir(spark)
    blocks = read_block_statistics(spark, table_path).checkpoint(eager=True)
    return admm.problem_from_blocks(blocks, rho, names)

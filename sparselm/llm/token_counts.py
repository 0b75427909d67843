"""Exact token counts for every context limit (operator 7).

One pass encodes every document; only its length goes on.  Documents are
aggregated by encoded length, and suffix sums over the length histogram answer
for every limit that changes an answer (the distinct lengths): how many
documents are longer, how many tokens a truncation keeps, and which share of
documents and tokens is at or below the limit.  The histogram has one row per
distinct length; its running sums are taken inside ranges of lengths and over
the ranges' totals, so no window covers the whole histogram.

A null or empty text has length 0.  Repeated rows count as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparselm.llm.tables import saved
from sparselm.llm.textblock import text_slices
from sparselm.llm.tokens import default_tokenizer, encoder

RANGE = 1024                # lengths of one range of the histogram


def _length_pass(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in text_slices(whole, "text"):
                _, off = enc.encode(b.column("text"), with_ids=False)
                size, count = np.unique(np.diff(off), return_counts=True)   # map-side combine
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size), pa.array(count.astype(np.int64))], names=["length", "n"])
    return run


def length_histogram(docs: DataFrame, text_col: str = "text",
                     tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs): documents by encoded length, without special ids."""
    src = docs.select(F.col(text_col).alias("text"))
    return (src.mapInArrow(_length_pass(tokenizer or default_tokenizer()), "length long, n long")
            .groupBy("length").agg(F.sum("n").alias("n_docs")))


def token_counts(spark: SparkSession, docs: DataFrame, text_col: str = "text",
                 tokenizer: str | None = None) -> DataFrame:
    """One row per distinct length, as a context limit: n_docs of that length,
    n_longer, total_tokens of all documents, truncated_tokens (every document
    cut to the limit), tokens_within (of documents not longer), doc_share and
    token_share (of documents at or below the limit, and of their tokens: the
    limit is the doc_share quantile of the lengths)."""
    hist = saved(spark, length_histogram(docs, text_col, tokenizer), "token-lengths")
    hist = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn(
        "range", F.floor(F.col("length") / RANGE))
    totals = hist.groupBy("range").agg(F.sum("n_docs").alias("rn"), F.sum("tokens").alias("rt"))
    after = Window.orderBy(F.col("range").desc())       # one row per 1,024 lengths
    totals = totals.select(
        "range", (F.sum("rn").over(after) - F.col("rn")).alias("n_above"),
        (F.sum("rt").over(after) - F.col("rt")).alias("t_above"))
    docs_, tokens_ = hist.agg(F.sum("n_docs"), F.sum("tokens")).first()     # two numbers
    docs_, tokens_ = F.lit(docs_ or 0).cast("long"), F.lit(tokens_ or 0).cast("long")
    inside = Window.partitionBy("range").orderBy(F.col("length").desc())
    longer = F.sum("n_docs").over(inside) - F.col("n_docs") + F.col("n_above")
    beyond = F.sum("tokens").over(inside) - F.col("tokens") + F.col("t_above")
    sums = hist.join(totals, "range").select(
        "length", "n_docs", longer.alias("n_longer"), beyond.alias("t_longer"))
    within = tokens_ - F.col("t_longer")
    return sums.select(
        F.col("length").alias("context_limit"), "n_docs", "n_longer",
        tokens_.alias("total_tokens"),
        (within + F.col("n_longer") * F.col("length")).alias("truncated_tokens"),
        within.alias("tokens_within"),
        ((docs_ - F.col("n_longer")) / F.nullif(docs_, F.lit(0))).alias("doc_share"),
        F.when(tokens_ == 0, 1.0).otherwise(within / F.nullif(tokens_, F.lit(0)))
        .alias("token_share"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Shared helpers of the corpus operators: inputs, intermediate tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselm.session import delete_path, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and
    read it back: cuts lineage, and every later reader sees the same rows."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables written by :func:`saved` whose last reader is done."""
    for df in frames:
        delete_path(spark, df.saved_path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> Column:
    """64-bit text fingerprint; with the document id it names a document row,
    so rows that repeat an id with another text stay apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def crc_mod5(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo 5 (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
                  F.lit(5))


def here(*parts: str) -> str:
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), *parts)

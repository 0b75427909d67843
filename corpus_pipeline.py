"""Corpus pipeline: quality filter, near-duplicate removal, benchmark
decontamination, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage's rows as Parquet to the shared folder of
``spark.checkpoint.dir`` and reads them back for the next.  All stages but the
last return the columns of their input, whatever else they are called.

Documents are told apart by id and text: rows that repeat both are one
document.  Nulls follow the operators: a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselm.llm import decontaminate, minhash_dedup, packing, quality, secret_scan
from sparselm.llm.tables import saved, table, text_key


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key): all columns, and the document's identity.  Structs compare
    null-safe, so null ids join too."""
    return docs.select(F.struct("*").alias("row"), F.struct(
        F.col("doc_id").alias("id"), text_key().alias("tkey")).alias("key"))


def _key(found: DataFrame) -> DataFrame:
    return found.select(F.struct("id", "tkey").alias("key"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of good quality stay."""
    model = quality.learn(docs, quality.train_split(table(spark, sf_dir, "labels")))
    return docs.where(quality.score_of(spark, F.col("text"), model) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.  28 bands of 5
    slots: a pair at the stage's 0.8 is missed with probability 1.5e-5."""
    kept = minhash_dedup.keepers(minhash_dedup.near_duplicates(spark, docs, slots=140, band_rows=5))
    return _keyed(docs).join(_key(kept), "key", "left_semi").dropDuplicates(["key"]).select(
        "row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    return _keyed(docs).join(_key(found.where("contaminated")), "key", "left_anti").select(
        "row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows where that changes it."""
    found = docs.select(F.struct("*").alias("row"),
                        secret_scan.masked_or_null(F.col("text")).alias("masked"))
    changed = F.col("masked").isNotNull()
    new = {"text": lambda old: F.coalesce("masked", old),
           "n_chars": lambda old: F.when(changed, F.char_length("masked").cast(
               dict(docs.dtypes)["n_chars"])).otherwise(old)}
    return found.select(*[new.get(c, lambda old: old)(F.col("row").getField(c)).alias(c)
                          for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a fixed-length sequence."""
    return packing.pack(spark, docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_masking", mask_secrets),
    ("packing", pack_sequences),
]

# no stage but the third can be said in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Suffix-array dedup: bytes that lie in a repeated long string (operator 1).

A byte is removed if some ``length``-byte string that covers it also starts
anywhere else, in the same document or another.

1. Windows are grouped into blocks placed by their content (``windows``), so
   equal windows lie in blocks of equal core.  Cores are counted; blocks whose
   core is unique hold no repeated window and go no further.
2. Equal blocks (*variants* of a core) are one row with a count.  A variant of
   a core without others is repeated in full.  All variants of cores that have
   several are suffix-sorted: cores are dealt to tasks by a hash, in parcels of
   about ``PARCEL`` bytes; the task sorts the suffixes at window starts in two
   stages, takes adjacent common prefixes, and reports the starts that share
   ``length`` bytes with another start (``suffix_array``).
3. A core with more than ``MOST_VARIANTS`` variants (one passage between ever
   different neighbours) is not gathered: each of its windows is counted by
   its own fingerprint, which is exact as well.
4. Repeated windows go back to the documents, where their bytes are cut out.

Joins deal the rows of a core, a variant or a window with more than ``MOST_ROWS``
of them to several tasks (``dealt_join``), so a passage or a text with many copies
is no task of its own.

Texts are shuffled once, to fetch the variants' bytes, and those of documents
with a repeated core once more.  Strings are told apart by 64-bit hashes within
equal cores, or byte by byte in the suffix arrays.

A null or empty text has 0 bytes and none removed.  Rows that repeat id and
text are two occurrences: all their windows repeat.  Ids may be null.  Texts
shorter than ``length`` stay whole.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselm.llm import textblock
from sparselm.llm.suffix_array import repeated_starts
from sparselm.llm.tables import saved, table, text_key
from sparselm.llm.windows import window_blocks

LENGTH = 400
BLOCK_SLICE = 1 << 20       # text cut into blocks at a time; some 80 bytes of work space each
PARCEL = 2 << 20            # bytes of one suffix-sorted parcel, about
MOST_VARIANTS = 4096        # of one core; at most some 2 MB
MOST_ROWS = 1024            # of one key that a join leaves to one task, about


def _block_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textblock.text_slices(whole, "text", BLOCK_SLICE):
                data, off = textblock.block(b.column("text"), lower=False)
                text, ref, first, last, core, hull = window_blocks(
                    data, off, length, textblock.RangeHasher(data))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(pa.array(text)), pa.array(core.view(np.int64)),
                     pa.array(hull.view(np.int64)),
                     pa.array((ref - first - off[text]).astype(np.int64)),
                     pa.array((first - last).astype(np.int32)), pa.array(first.astype(np.int32))],
                    names=["doc", "core", "hull", "start", "width", "back"])
    return run


def _cut_pass(length: int):
    """Bytes of the asked variants; of windows of crowded cores, hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in textblock.text_slices(whole, "text")):
            rows = {k: [] for k in ("core", "hull", "width", "back", "n", "bytes", "windows")}
            for text, asks in zip(b.column("text").to_pylist(), b.column("asks").to_pylist()):
                raw = (text or "").encode()
                hashes = None
                for a in asks or ():
                    for k in ("core", "hull", "width", "back", "n"):
                        rows[k].append(a[k])
                    s, e = a["start"], a["start"] + a["width"] + length
                    if a["crowded"]:
                        if hashes is None:
                            hashes = textblock.RangeHasher(
                                np.frombuffer(raw, np.uint8)).windows(length).view(np.int64)
                        rows["windows"].append(hashes[s:s + a["width"] + 1])
                        rows["bytes"].append(None)
                    else:
                        rows["windows"].append(None)
                        rows["bytes"].append(raw[s:e])
            kinds = {"width": pa.int32(), "back": pa.int32(), "bytes": pa.binary(),
                     "windows": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()],
                names=list(rows))
    return run


def _sorted_parcel(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of repeated starts of every variant of a parcel."""
        pdf = pdf.drop_duplicates(["core", "hull"])
        found = repeated_starts(list(pdf["bytes"]), pdf["width"].to_numpy(np.int64),
                                pdf["n"].to_numpy(np.int64), length)
        out = {"core": [], "hull": [], "a": [], "b": []}
        for core, hull, at in zip(pdf["core"], pdf["hull"], found):
            if len(at) == 0:
                continue
            cut = np.flatnonzero(np.diff(at) > 1)
            for x, y in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]):
                out["core"].append(core)
                out["hull"].append(hull)
                out["a"].append(x)
                out["b"].append(y)
        return pd.DataFrame(out).astype({"a": "int32", "b": "int32", "core": "int64",
                                         "hull": "int64"})
    return run


def dealt_join(rows: DataFrame, other: DataFrame, keys: list[str],
               counts: DataFrame) -> DataFrame:
    """``rows`` joined to ``other`` by ``keys``.  A key with more than ``MOST_ROWS``
    rows, by the ``n_rows`` of ``counts``, is split into parts of about so many:
    its rows are dealt to the parts in turn, its rows of ``other`` go to each.
    ``counts`` has a key once; one in ``MOST_ROWS`` rows at most has its key
    broadcast."""
    split = F.broadcast(counts.where(F.col("n_rows") > MOST_ROWS).select(
        *keys, F.ceil(F.col("n_rows") / MOST_ROWS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("turn", F.monotonically_increasing_id()).join(
        split, keys, "left").withColumn("part", F.pmod("turn", parts)).drop("turn", "parts")
    other = other.join(split, keys, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return rows.join(other, [*keys, "part"]).drop("part")


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) spans; touching ones are one run."""
    if len(spans) == 0:
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.r_[at[1:], len(spans)] - 1]], axis=1)


def _remove_pass(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in textblock.text_slices(whole, "text")):
            removed, count, sha, spans, texts = [], [], [], [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("found")):
                raw = (text or "").encode()
                f = found.values            # of this row
                start = f.field("start").to_numpy()
                runs = merged(np.stack([start, start + f.field("more").to_numpy() + length], 1))
                kept, at = [], 0
                for s, e in runs.tolist():
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                removed.append(len(raw) - len(kept))
                count.append(len(runs))
                sha.append(hashlib.sha256(kept).hexdigest())
                spans.append([{"start": s, "end": e} for s, e in runs.tolist()])
                texts.append(kept)
            cols = [b.column("doc"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()),
                                                        ("end", pa.int64())])))]
            names = ["doc", "n_removed", "n_spans", "kept_sha256", "spans"]
            if with_text:
                cols.append(pa.array(texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType())]))


def repeated_strings(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", length: int = LENGTH,
                     with_text: bool = False) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept_sha256,
    spans (byte ranges removed; null if none) and, with ``with_text``, the kept
    bytes (null if all are kept)."""
    if length < 200:
        raise ValueError("repeated strings of fewer than 200 bytes are not supported")
    # structs compare null-safe, so rows with a null id join too
    src = docs.select(F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("tkey"))
                      .alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    doc = T.StructField("doc", src.schema["doc"].dataType)
    blocks = saved(spark, src.mapInArrow(_block_pass(length), T.StructType([
        doc, T.StructField("core", T.LongType()), T.StructField("hull", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("width", T.IntegerType()),
        T.StructField("back", T.IntegerType())])), "sa-blocks")
    repeated = saved(spark, blocks.groupBy("core").agg(F.count("*").alias("n_rows")).where(
        "n_rows > 1"), "sa-cores")
    blocks = saved(spark, dealt_join(blocks, repeated.select("core"), ["core"], repeated),
                   "sa-repeated")

    variants = saved(spark, blocks.groupBy("core", "hull", "width", "back").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("where")), "sa-variants")
    same = variants.select("core", "hull", F.col("n").alias("n_rows"))
    crowd = variants.groupBy("core").agg(F.count("*").alias("variants"))
    variants = dealt_join(variants, crowd, ["core"],
                          crowd.select("core", F.col("variants").alias("n_rows")))
    alone = variants.where("variants = 1").select(
        "core", "hull", F.lit(0).alias("a"), F.col("width").alias("b"))

    asks = variants.where("variants > 1").groupBy("where.doc").agg(F.collect_list(F.struct(
        "core", "hull", "width", "back", "n", F.col("where.start").alias("start"),
        (F.col("variants") > MOST_VARIANTS).alias("crowded"))).alias("asks"))
    touched = blocks.select("doc").distinct().join(asks, "doc", "left")
    texts = saved(spark, src.join(touched, "doc"), "sa-texts")
    parts = saved(spark, texts.where("asks IS NOT NULL").select("text", "asks").mapInArrow(
        _cut_pass(length), "core long, hull long, width int, back int, n long, bytes binary, "
                           "windows array<long>"), "sa-variant-bytes")

    amount = parts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parcels = int(amount) // PARCEL + 1
    by_array = parts.where("bytes IS NOT NULL").withColumn(
        "parcel", F.pmod(F.xxhash64("core"), F.lit(parcels))).groupBy("parcel").applyInPandas(
        _sorted_parcel(length), "core long, hull long, a int, b int")

    window = parts.where("windows IS NOT NULL").dropDuplicates(["core", "hull"]).select(
        "core", "hull", "back", "n", F.posexplode("windows").alias("at", "window"))
    window = window.withColumn("back", F.col("back") - F.col("at"))
    at = ["core", "back", "window"]
    counted = window.groupBy(*at).agg(F.sum("n").alias("times"), F.count("*").alias("n_rows")).where(
        "times > 1")
    by_count = dealt_join(window, counted.select(*at), at, counted).select(
        "core", "hull", F.col("at").alias("a"), F.col("at").alias("b"))

    found = alone.union(by_array).union(by_count)
    spans = dealt_join(blocks.select("doc", "core", "hull", "start"), found, ["core", "hull"],
                       same).groupBy("doc").agg(F.collect_list(F.struct(
                           (F.col("start") + F.col("a")).alias("start"),
                           (F.col("b") - F.col("a")).alias("more"))).alias("found"))
    fields = [doc, T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
              T.StructField("kept_sha256", T.StringType()), T.StructField("spans", _SPANS)]
    if with_text:
        fields.append(T.StructField("kept", T.BinaryType()))
    cut = texts.select("doc", "text").join(spans, "doc").mapInArrow(
        _remove_pass(length, with_text), T.StructType(fields)).dropDuplicates(["doc"])

    whole = src.select("doc", F.octet_length("text").cast("long").alias("n_bytes"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    out = whole.join(cut, "doc", "left")
    return out.select(
        "doc.id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans",
        *(["kept"] if with_text else []))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(spark, table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

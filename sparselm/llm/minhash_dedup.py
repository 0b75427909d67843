"""MinHash near-duplicates by SuperMinHash signatures (operator 10).

1. One Arrow pass per document: words, the set of distinct word shingles, its
   SuperMinHash signature and band keys.  Documents with equal sets form one
   *class* (128-bit fingerprint of the sorted set); copies go no further.
2. Classes that agree on a band meet in a bucket.  Links are confirmed on the
   full shingle sets, never on the signatures:
   - star rounds compare the members of a bucket with a few pivots (first one,
     then those with most links); members already joined need no comparison;
   - what is left, pairs of members of different components of one bucket that
     were not compared, is compared in full, block by block; a task holds two
     blocks of bounded size and returns only the links that join components.
   A group of N near copies thus costs about N comparisons as long as some
   member links the others, and no group is ever held in one task.
3. Connected components of the links; class labels go back to the documents.

Recall is that of the bands: with 24 bands of 6 slots a pair of Jaccard
similarity 0.85 misses all bands with probability 1.2e-5, one of 0.8 with 7e-4;
``slots=140, band_rows=5`` brings the latter to 1.5e-5 for more candidates.

Nulls and degenerate rows: a null or empty text, or one without words, has an
empty set and links with nothing; fewer words than a shingle give one shingle
of the whole sequence.  A null id is never a component label: such rows are
labelled by the smallest id of their component, null if there is none, and a
row whose id and label are both null is kept.  Rows that repeat an id with the
same text carry the same label.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselm.llm import textblock
from sparselm.llm.components import connected_components
from sparselm.llm.superminhash import band_keys, signatures
from sparselm.llm.tables import saved, text_key

SLOTS, BAND_ROWS = 144, 6
SHINGLE = 5
BLOCK_MEMBERS = 256         # members of one block of the exact phase
STAR_PIVOTS = (1, 8)


def _sets(batch: pa.RecordBatch, shingle: int):
    data, off = textblock.block(batch.column("text"))
    words, doc = textblock.word_hashes(data, off)
    return textblock.shingle_hashes(words, doc, batch.num_rows, shingle)


def _fingerprint(values: np.ndarray) -> bytes:
    """128 bits of a sorted set of 64-bit values."""
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def _signature_pass(shingle: int, slots: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textblock.text_slices(whole, "text"):
                h, d = _sets(b, shingle)
                n = b.num_rows
                keys = band_keys(signatures(h, d, n, slots), rows).view(np.int64)
                at = np.searchsorted(d, np.arange(n + 1))
                ids = [_fingerprint(h[at[i]:at[i + 1]]) if at[i + 1] > at[i] else None
                       for i in range(n)]
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]),
                    pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("tkey"), pa.array(ids, pa.binary()),
                     pa.array(np.diff(at).astype(np.int64)), bands],
                    names=["id", "tkey", "cls", "n_shingles", "bands"])
    return run


def _set_pass(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textblock.text_slices(whole, "text"):
                h, d = _sets(b, shingle)
                at = np.searchsorted(d, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls"), pa.array([h[at[i]:at[i + 1]].tobytes()
                                                for i in range(b.num_rows)], pa.binary())],
                    names=["cls", "elements"])
    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _star_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The pivot of the group against its members."""
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
        at = {c: i for i, c in enumerate(pdf["cls"])}
        pivot = pdf["pivot"].iloc[0]
        p = sets[at[pivot]]
        out = [c for c, i in at.items() if c != pivot and _linked(p, sets[i], percent)]
        return pd.DataFrame({"a": [pivot] * len(out), "b": out}, dtype=object)
    return run


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pairs of different components between two blocks of a bucket
        (or inside one); returns links that join components, a forest."""
        pdf = pdf.drop_duplicates(["cls", "side"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
        side = pdf["side"].to_numpy()
        cls = pdf["cls"].tolist()
        parent = {c: c for c in pdf["component"]}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        comp = pdf["component"].tolist()
        size = np.array([len(s) for s in sets])
        codes, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        step = max(1, (64 << 20) // (4 * len(sets)))        # 64 MB of incidence at a time
        order = np.argsort(inverse, kind="stable")
        inv, own = inverse[order], owner[order]
        for lo in range(0, len(codes), step):
            s, e = np.searchsorted(inv, [lo, lo + step])
            m = np.zeros((len(sets), min(step, len(codes) - lo)), dtype=np.float32)
            m[own[s:e], inv[s:e] - lo] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        hit = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        two = bool((side == 1).any())
        out = []
        for i, j in zip(*np.nonzero(np.triu(hit, 1))):
            if two and side[i] == side[j]:
                continue
            ri, rj = root(comp[i]), root(comp[j])
            if ri != rj:
                parent[ri] = rj
                out.append((cls[i], cls[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)
    return run


_LINK = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", percent: int = 80, shingle: int = SHINGLE,
                    slots: int = SLOTS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per document row: ``id, tkey, n_shingles, component_id, kept``
    and ``component``, the component's own key (null for an empty set).

    Documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of distinct word shingles; ``component_id`` is the smallest id
    reachable by links.  ``tkey`` is the text fingerprint of ``text_key``.
    """
    src = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tkey"),
                      F.col(text_col).alias("text"))
    schema = T.StructType([
        src.schema["id"], T.StructField("tkey", T.LongType()),
        T.StructField("cls", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = src.mapInArrow(_signature_pass(shingle, slots, band_rows), schema)

    # one row per class with its bands and a document that carries its text
    marked = saved(spark, signed, "nd-signed")
    rows = marked.select("id", "tkey", "cls", "n_shingles")
    classes = (marked.where("cls IS NOT NULL").groupBy("cls")
               .agg(F.min(F.struct("id", "tkey")).alias("rep"), F.min("id").alias("low"),
                    F.first("bands").alias("bands")))
    classes = saved(spark, classes, "nd-classes")

    keyed = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = saved(spark, keyed.join(shared, "bucket"), "nd-members")

    wanted = members.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select(
        "cls", F.col("rep.id").alias("id"), F.col("rep.tkey").alias("tkey"))
    texts = (src.join(wanted, src["id"].eqNullSafe(wanted["id"]) & (src["tkey"] == wanted["tkey"]))
             .select("cls", "text"))
    sets = texts.mapInArrow(_set_pass(shingle), "cls binary, elements binary")
    sets = saved(spark, sets.groupBy("cls").agg(F.first("elements").alias("elements")), "nd-sets")

    links = _confirmed_links(spark, members, sets, percent)
    comp = connected_components(spark, links)
    label = classes.select("cls", "low").join(
        comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    lows = label.groupBy("component").agg(F.min("low").alias("component_id"))
    label = label.join(lows, "component").select("cls", "component", "component_id")
    out = rows.join(label, "cls", "left")
    cid = F.coalesce("component_id", "id")
    return out.select("id", "tkey", "n_shingles", cid.alias("component_id"),
                      F.col("id").eqNullSafe(cid).alias("kept"), "component")


def keepers(found: DataFrame) -> DataFrame:
    """(id, tkey) of one document per component, the one of smallest id (a null
    id last), and of every document with an empty set."""
    best = found.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "tkey")).alias("k"))
    return best.select("k.id", "k.tkey").union(
        found.where("component IS NULL").select("id", "tkey").distinct())


def _confirmed_links(spark: SparkSession, members: DataFrame, sets: DataFrame,
                     percent: int) -> DataFrame:
    """Links that give every bucket its components (columns a, b)."""
    links = spark.createDataFrame([], _LINK)
    tested = None               # (bucket, pivot) pairs that met their whole bucket
    state = members.withColumn("component", F.col("cls"))
    for p in STAR_PIVOTS:
        # a bucket is open while members of different components meet in it
        if tested is not None:
            state = state.join(tested, ["bucket", "cls"], "left_anti")
        open_ = state.groupBy("bucket").agg(
            F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
        live = saved(spark, state.join(open_.select("bucket"), "bucket", "left_semi"), "nd-live")
        degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(
            F.count("*").alias("links"))
        cand = live.join(degree, "cls", "left")
        best = cand.groupBy("bucket").agg(_pivots(F.struct(
            F.coalesce("links", F.lit(0)).alias("links"),
            F.xxhash64("bucket", "cls").alias("h"), "cls"), p).alias("best"))
        pivots = best.select("bucket", F.explode("best").alias("x")).select(
            "bucket", F.col("x.cls").alias("pivot"))
        pivots = saved(spark, pivots, "nd-pivots")
        own = live.select("bucket", F.col("cls").alias("pivot"),
                          F.col("component").alias("pivot_component"))
        pairs = (live.join(pivots.join(own, ["bucket", "pivot"]), "bucket")
                 .where("component <> pivot_component")
                 .select("pivot", "cls").distinct())
        pairs = saved(spark, pairs, "nd-pairs")
        per = pairs.groupBy("pivot").agg(F.count("*").alias("n"))
        dealt = pairs.join(per, "pivot").select(
            "pivot", "cls", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("k")).withColumn(
            "part", F.pmod(F.xxhash64("cls"), "k").cast("int"))
        heads = per.select("pivot", F.col("pivot").alias("cls"),
                           F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK_MEMBERS)
                                                .cast("int") - 1)).alias("part"))
        todo = dealt.select("pivot", "cls", "part").union(heads).join(sets, "cls")
        found = todo.groupBy("pivot", "part").applyInPandas(_star_links(percent), _LINK)
        links = saved(spark, links.union(found), "nd-links")
        done = pivots.select("bucket", F.col("pivot").alias("cls"))
        tested = done if tested is None else tested.union(done)
        comp = connected_components(spark, links).withColumnRenamed("id", "cls")
        state = saved(spark, members.join(comp, "cls", "left").withColumn(
            "component", F.coalesce("component", "cls")), "nd-state")

    # exact remainder: members not yet compared, in blocks of bounded size
    rest = state.join(tested, ["bucket", "cls"], "left_anti")
    # a bucket's largest component is not compared with itself: its blocks meet
    # the other members' blocks only
    parts = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("bucket").agg(
        F.max_by("component", "n").alias("main"), F.sum("n").alias("n"),
        F.max("n").alias("n_main")).where("n > n_main")
    blocks = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")       # noqa: E731
    rest = rest.join(open_.select("bucket", "main", blocks(F.col("n") - F.col("n_main"))
                                  .alias("k"), blocks(F.col("n_main")).alias("k_main")), "bucket")
    h = F.xxhash64("cls")
    rest = rest.withColumn("is_main", F.col("component") == F.col("main")).withColumn(
        "block", F.when(F.col("is_main"), F.col("k") + F.pmod(h, "k_main"))
        .otherwise(F.pmod(h, "k")).cast("int"))
    met = rest.select("bucket", "cls", "component", "block", F.explode(F.sequence(
        F.lit(0), F.when(F.col("is_main"), F.col("k")).otherwise(F.col("k") + F.col("k_main"))
        - 1)).alias("other"))
    met = met.select(
        "bucket", "cls", "component", F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))
    found = met.join(sets, "cls").groupBy("bucket", "i", "j").applyInPandas(
        _block_links(percent), _LINK)
    return saved(spark, links.union(found), "nd-links")


def _pivots(value, p: int):
    """The largest struct of each of p hash classes of a bucket's members: a
    bounded aggregate, so no group is sorted or collected."""
    slot = F.pmod(F.xxhash64(value.getField("cls")), F.lit(p))
    return F.filter(F.array(*[F.max(F.when(slot == i, value)) for i in range(p)]),
                    lambda x: x.isNotNull())


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs, percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")

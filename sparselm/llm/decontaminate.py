"""Benchmark decontamination through a positional inverted index (operator 3).

Built from DataFrame functions only.

1. A *window* is ``n`` consecutive words of a test item (a shorter item is one
   window).  Corpus frequencies of the items' words order each window's terms;
   a window with a term that the corpus lacks is dropped.
2. The index stores the postings (term, document, position) of every window's
   rarest terms, the ``SEEDS`` rarest offsets of each window.
3. Lists are intersected from the rarest term: its postings, moved back by the
   term's offset, propose window starts; the postings of the next terms, offset
   likewise, keep those that agree.
4. The surviving starts are compared with the document's words in full.

Frequent words are only ever counted (with map-side combining), unless all of a
window's words are frequent.  Joins are plain equi-joins on (document, term,
position) or on a term, which adaptive execution can split.  ``proximity``
answers near matches from the same postings.

A document row is identified by its id and a fingerprint of its text, compared
null-safe, so null and repeated ids are harmless.  A null or empty text, or one
without words, is never hit; such an item has no windows.  A null item id is
not reported, its windows count as hits.  Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparselm.llm.tables import saved, table, text_key
from sparselm.llm.words import words

WINDOW = 10
SEEDS = 3


def item_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """(item_id, window: array<string>), distinct."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))))
    return w.select("item_id", F.slice("w", F.col("i"), n).alias("window")).distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tkey"),
                       F.col(text_col).alias("text"))


class PositionalIndex:
    """Postings of the rarest window terms of a set of test items."""

    def __init__(self, spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = WINDOW,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", seeds: int = SEEDS):
        self.spark, self.n, self.n_seeds = spark, n, seeds
        self.docs = _keyed(docs, id_col, text_col)
        self.item_windows = saved(spark, item_windows(items, n, item_col, item_text).withColumn(
            "wid", F.concat_ws(" ", "window")), "bm-windows")
        windows = self.item_windows.select("wid", "window").distinct()
        terms = windows.select("wid", F.posexplode("window").alias("offset", "term"))
        vocabulary = saved(spark, terms.select("term").distinct(), "bm-terms")

        # corpus frequency of the items' words
        tokens = self.docs.select(F.explode(words(F.col("text"))).alias("term"))
        counted = tokens.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("freq"))
        ranked = terms.join(counted, "term", "left").withColumn(
            "rank", F.row_number().over(Window.partitionBy("wid").orderBy(
                F.coalesce("freq", F.lit(0)), "offset")))
        ranked = ranked.where(F.col("rank") <= seeds).withColumn(
            "lost", F.max(F.col("freq").isNull()).over(Window.partitionBy("wid")))
        self.seeds = saved(spark, ranked.where("NOT lost").select(
            "wid", "rank", "offset", "term", "freq"), "bm-seeds")

        wanted = saved(spark, self.seeds.select("term").distinct(), "bm-seed-terms")
        posted = self.docs.select("id", "tkey", F.posexplode(words(F.col("text"))).alias(
            "pos", "term"))
        self.postings = saved(spark, posted.join(wanted, "term"), "bm-postings")

    def candidates(self) -> DataFrame:
        """(id, tkey, wid, start): starts on which the rarest terms agree."""
        def seed(rank: int) -> DataFrame:
            return self.seeds.where(F.col("rank") == rank).select("wid", "offset", "term")

        found = self.postings.join(seed(1), "term").select(
            "id", "tkey", "wid", (F.col("pos") - F.col("offset")).alias("start")).where(
            "start >= 0")
        for rank in range(2, self.n_seeds + 1):
            asked = found.join(seed(rank), "wid", "left").withColumn(
                "pos", F.col("start") + F.col("offset"))
            p = self.postings.select(F.col("id").alias("pid"), F.col("tkey").alias("ptkey"),
                                     F.col("term").alias("pterm"), F.col("pos").alias("ppos"))
            met = asked.where("term IS NOT NULL").join(
                p, F.col("id").eqNullSafe(F.col("pid")) & (F.col("tkey") == F.col("ptkey"))
                & (F.col("term") == F.col("pterm")) & (F.col("pos") == F.col("ppos")),
                "left_semi")
            found = met.union(asked.where("term IS NULL")).select("id", "tkey", "wid", "start")
        return found.distinct()

    def matches(self) -> DataFrame:
        """One row per document row: id, tkey, n_words, hits (array of the
        exact window places: start, len, wid)."""
        per = self.candidates().groupBy("id", "tkey").agg(
            F.collect_list(F.struct("start", "wid")).alias("places"))
        d = self.docs.alias("d").join(
            per.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id"))
            & (F.col("d.tkey") == F.col("c.tkey")), "left").select(
            "d.id", "d.tkey", words(F.col("d.text")).alias("w"), "c.places")
        # a window's words never hold a space
        hit = F.filter("places", lambda p: F.concat_ws(" ", F.slice(
            F.col("w"), p["start"] + 1, F.size(F.split(p["wid"], " ")))) == p["wid"])
        return d.select("id", "tkey", F.size("w").cast("long").alias("n_words"), hit.alias("hits"))


def hit_words(hits: Column) -> Column:
    """Number of distinct word positions inside any of the places."""
    covered = F.flatten(F.transform(hits, lambda h: F.sequence(
        h["start"], h["start"] + F.size(F.split(h["wid"], " ")) - 1)))
    return F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row per document row: id, tkey, n_words, n_hit, item_ids (distinct,
    sorted as strings), contaminated."""
    index = PositionalIndex(spark, docs, items, n, id_col, text_col, item_col, item_text)
    m = saved(spark, index.matches().withColumn(
        "hits", F.when(F.size("hits") > 0, F.col("hits"))), "bm-matches")
    named = m.select("id", "tkey", F.explode("hits").alias("h")).select(
        "id", "tkey", F.col("h.wid").alias("wid")).distinct().join(
        index.item_windows.select("wid", F.col("item_id").cast("string").alias("item")), "wid")
    named = named.groupBy("id", "tkey").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    out = m.alias("m").join(named.alias("i"), F.col("m.id").eqNullSafe(F.col("i.id"))
                            & (F.col("m.tkey") == F.col("i.tkey")), "left")
    return out.select(
        "m.id", "m.tkey", "n_words", hit_words(F.col("hits")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("hits").isNotNull().alias("contaminated"))


def proximity(index: PositionalIndex, slop: int = 2) -> DataFrame:
    """Near matches: places where the two rarest terms of a window stand in the
    right order, but up to ``slop`` words closer or farther than in the window
    (id, tkey, wid, start, shift; shift 0 is a match of the two)."""
    a = index.postings.join(index.seeds.where("rank = 1"), "term").select(
        "id", "tkey", "wid", (F.col("pos") - F.col("offset")).alias("start"))
    b = index.postings.join(index.seeds.where("rank = 2"), "term").select(
        F.col("id").alias("bid"), F.col("tkey").alias("btkey"), F.col("wid").alias("bwid"),
        (F.col("pos") - F.col("offset")).alias("bstart"))
    # each shift is an equality, so the join never pairs all places of a document
    a = a.withColumn("shift", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
    return a.join(b, F.col("id").eqNullSafe(F.col("bid")) & (F.col("tkey") == F.col("btkey"))
                  & (F.col("wid") == F.col("bwid"))
                  & (F.col("start") + F.col("shift") == F.col("bstart"))).select(
        "id", "tkey", "wid", "start", "shift").distinct()


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, table(spark, sf_dir, "documents"),
                          table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS wid
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
        FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS wid
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, sizes WHERE len(w) >= n)),
hits AS (
  SELECT p.doc_id, p.s, p.n, windows.item_id FROM places p JOIN windows USING (wid, n)),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

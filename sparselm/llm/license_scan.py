"""License scans by an exact set-similarity join (operator 2).

Built from DataFrame functions only.  Two findings per document:

* *base*: places where a phrase's words stand consecutively;
* *templates*: text blocks whose word set contains at least ``threshold`` of a
  license template's word set.  A block is a run of ceil(L / threshold) words
  of the text, L the template's number of words, wherever lines break (a shorter
  text is one block).  Tokens are ordered by their corpus frequency, rarest
  first.  With o = ceil(threshold * |T|) words to be shared, a block that meets T
  holds one of T's first |T| - o + 1 tokens (prefix filter), so only the blocks
  around those are looked at; the words around must hold o of T's tokens from the
  shared one on (positional filter).  What passes is compared in full, block by
  block, so the join is exact.

Only template words are counted and ordered: words that are in no template can
add nothing to an overlap.  The templates are constants of this module (or a
caller's short list); frequencies of their words, at most a few hundred rows,
are the only thing that reaches the driver.  Only the words within a block's reach of a
prefix token are written and joined.

A null or empty text has no words, places or labels and score 0.  Rows that
repeat id and text get the same result; ids may be null.  Empty tables give
empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselm.llm.tables import saved, table, text_key
from sparselm.llm.words import words

# fixed values: phrases of the base finding, and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"),
           ("general public license", "gpl"))

# fixed values: notices of public licenses, and their labels
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files (the \"Software\"), to deal in "
            "the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
               "use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software "
            "Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, "
            "are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, "
            "v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International "
              "License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
THRESHOLD = 0.9


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, tokens: distinct words, n_words)."""
    raw = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)],
                                "template int, label string, text string")
    return raw.select("template", "label", F.array_distinct(words(F.col("text"))).alias("tokens"),
                      F.size(words(F.col("text"))).alias("n_words"))


def _preceded(w: Column, back: int, part: str):
    return lambda i: (i >= back) & (F.get(w, i - back) == part)


def _places(w: Column, phrase: str) -> Column:
    """Starts of a phrase among the words."""
    parts = phrase.split()
    last = len(parts) - 1
    ends = F.filter(F.transform(w, lambda x, i: F.when(x == parts[last], i)),
                    lambda i: i.isNotNull())
    for back, part in enumerate(reversed(parts[:last]), 1):
        ends = F.filter(ends, _preceded(w, back, part))
    return F.transform(ends, lambda i: i - last)


def license_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", phrases=PHRASES, templates=TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: id, tkey, n_words, n_base, first_word,
    last_word, base_labels, labels (arrays, sorted), score (the highest
    template containment of a block; 1 where a base phrase stands), blocks (the
    best block around each prefix token that meets a template: line number of
    its first template word, template label, containment)."""
    src = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tkey"),
                      F.col(text_col).alias("text"))
    tmpl = template_table(spark, templates)
    vocabulary = sorted({t for r in tmpl.collect() for t in r["tokens"]})
    vocab = spark.createDataFrame([(t,) for t in vocabulary], "token string")

    # global order: rarest first
    freq = {r["token"]: r["n"] for r in src.select(
        F.explode(words(F.col("text"))).alias("token")).join(F.broadcast(vocab), "token")
        .groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda t: (freq.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index = []                  # of each template's prefix tokens
    reach = {}                  # words of the longest block around a prefix token
    for r in tmpl.collect():
        tokens = sorted(r["tokens"], key=rank.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        width = math.ceil(r["n_words"] / threshold - 1e-9)
        for p, t in enumerate(tokens[:len(tokens) - need + 1]):
            index.append((t, r["template"], r["label"], tokens, tokens[p:], need, width))
            reach[t] = max(reach.get(t, 0), width)
    prefix = sorted(reach)
    index = spark.createDataFrame(
        index, "token string, template int, label string, tokens array<string>, "
               "later array<string>, need int, width int")

    marks = F.array(*[F.lit(t) for t in prefix])
    reaches = F.create_map(*[F.lit(x) for t in prefix for x in (t, reach[t])])
    w = src.select("id", "tkey", "text", words(F.col("text")).alias("w"))
    has_mark = F.arrays_overlap("w", marks)
    starts = {}
    cols = []
    for k, (phrase, label) in enumerate(phrases):
        starts[label] = f"_at{k}"
        last = phrase.split()[-1]
        cols.append(F.when(F.array_contains("w", last), _places(F.col("w"), phrase))
                    .otherwise(F.array().cast("array<int>")).alias(f"_at{k}"))
    # words with their line numbers, of texts with a prefix token
    placed = F.when(has_mark, F.flatten(F.transform(
        F.split("text", "\n"), lambda x, i: F.transform(
            words(x), lambda t: F.struct(t.alias("t"), i.alias("line"))))))
    found = w.select("id", "tkey", F.size("w").cast("long").alias("n_words"), *cols,
                     placed.alias("placed"))
    at = F.filter(F.transform("placed", lambda x, i: F.when(F.array_contains(marks, x["t"]), i)),
                  lambda i: i.isNotNull())

    def around(i):
        token = F.get(F.col("placed"), i)["t"]
        wide = F.element_at(reaches, token)
        first = F.greatest(i - wide + 1, F.lit(0))
        return F.struct(token.alias("token"), (i - first).alias("at"),
                        F.slice("placed", first + 1, i - first + wide).alias("near"))

    found = saved(spark, found.withColumn("places", F.transform(at, around)).drop("placed"),
                  "license-blocks")

    # candidates: the words within a block's reach of a template's prefix token
    shared = found.select("id", "tkey", F.explode("places").alias("s")).select(
        "id", "tkey", "s.*").join(F.broadcast(index), "token")
    first = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
    shared = shared.select("id", "tkey", "label", "tokens", "later", "need", "width", F.slice(
        "near", first + 1, F.col("at") - first + F.col("width")).alias("near"))
    shared = shared.where(                                          # positional filter
        F.size(F.array_intersect("later", F.col("near.t"))) >= F.col("need"))
    # the best block, the first of equals
    n_near = F.size("near")
    starts_ = F.sequence(F.lit(1), F.greatest(n_near - F.col("width") + 1, F.lit(1)))
    best = F.array_max(F.transform(starts_, lambda i: F.struct(
        F.size(F.array_intersect("tokens", F.slice(F.col("near.t"), i, F.col("width"))))
        .alias("overlap"), (-i).alias("back"))))
    shared = shared.withColumn("best", best).where("best.overlap >= need").select(
        "id", "tkey", "label", "tokens", F.col("best.overlap").alias("overlap"),
        F.get(F.filter(F.slice("near", -F.col("best.back"), F.col("width")),
                       lambda x: F.array_contains("tokens", x["t"])), F.lit(0))["line"]
        .alias("line"))
    hits = shared.groupBy("id", "tkey").agg(
        F.collect_set("label").alias("more"),
        F.max(F.col("overlap") / F.size("tokens")).alias("best"),
        F.collect_set(F.struct("line", "label", (F.col("overlap") / F.size("tokens"))
                               .alias("containment"))).alias("blocks"))

    out = found.drop("places").alias("f").join(
        hits.alias("h"), F.col("f.id").eqNullSafe(F.col("h.id"))
        & (F.col("f.tkey") == F.col("h.tkey")), "left")
    every = F.concat(*[F.col(c) for c in starts.values()])
    none = F.array().cast("array<string>")
    base = F.array_sort(F.array_distinct(F.concat(*[
        F.when(F.size(c) > 0, F.array(F.lit(label))).otherwise(none)
        for label, c in starts.items()])))
    out = out.select(
        "f.id", "f.tkey", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), base.alias("base_labels"),
        F.coalesce("more", none).alias("more"), F.coalesce("best", F.lit(0.0)).alias("best"),
        F.sort_array("blocks").alias("blocks"))
    return out.select(
        "id", "tkey", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", "more")).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("best")).alias("score"), "blocks")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def _oracle() -> str:
    """DuckDB: brute force over every line and template (of notices on one line)."""
    split = ("list_filter(regexp_split_to_array(translate(coalesce({0}, ''), "
             "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
    q = lambda s: "'" + s.replace("'", "''") + "'"                  # noqa: E731
    values = ", ".join(f"({i}, {q(a)}, {q(t)})" for i, (a, t) in enumerate(TEMPLATES))
    place = " UNION ALL ".join(
        f"SELECT doc_id, s - 1 AS pos, {q(label)} AS label FROM (SELECT doc_id, w, "
        f"unnest(range(1, len(w) + 1)) AS s FROM d WHERE list_contains(w, 'license')) "
        f"WHERE array_to_string(w[s:s + {len(p.split()) - 1}], ' ') = {q(p)}"
        for p, label in PHRASES)
    return f"""
WITH d AS (SELECT doc_id, text, {split.format('text')} AS w FROM documents),
t AS (SELECT i, label, list_distinct({split.format('body')}) AS tokens
      FROM (VALUES {values}) AS v(i, label, body)),
places AS ({place}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                list(DISTINCT label) AS names FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, {split.format('line')} AS w
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
met AS (SELECT doc_id, label, len(list_intersect(tokens, w)) / len(tokens) AS part
        FROM lines, t
        WHERE len(list_intersect(tokens, w)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
more AS (SELECT doc_id, list(DISTINCT label) AS names, max(part) AS best
         FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.names), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(
           coalesce(base.names, []), coalesce(more.names, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLE = _oracle()

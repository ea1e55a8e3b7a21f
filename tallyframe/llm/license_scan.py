"""License scans by diagonal voting; DataFrame operations only.

Words of texts and of license templates are cut into rolling k-grams. Spark joins the hashes of all k-grams of the
texts to the templates' positions; each match votes for the diagonal (position in the text minus position in the
template). Votes are gathered by text, template and diagonal, as a mask of the template's places that were hit, and
neighbouring diagonals are merged. A span is verified by its places: each counts once, however often it was hit, and
no more than the words between the span's ends can hold; MIN_SHARE of the template's places must be there. Short templates
and phrases, which a word tells apart, must be held whole: all places on one diagonal, that is all their words in a row.
Equal hashes of 64 bits are taken for equal words.

Defined cases: a null text counts as empty, has no words and no labels; a phrase or template of fewer than two words
can't be used, nor a template of more than 64 words; overlapping places count each; repeated rows are scanned alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, lower_az

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2
#: Phrases that make the base: all their words in a row. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences of well-known licenses and notices, with labels. Fixed values.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("all rights reserved", "reserved"),
)
#: Share of a template's k-grams that a span must hold, diagonals by which inserted or lost words may shift it, and
#: k-grams below which a template must be held whole.
MIN_SHARE, MAX_SHIFT, SHORT = 0.6, 3, 8
#: Places of a template that a mask holds.
MAX_GRAMS = 63


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_hash(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def template_grams(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """template, label, grams (k-grams of the template), phrase (whether it must be held whole), offset, gram."""
    rows = []
    for phrase, entries in ((True, phrases), (False, templates)):
        for text, label in entries:
            ws = re.findall(WORD, text.lower())
            if len(ws) - GRAM + 1 > MAX_GRAMS:
                raise ValueError(f"a template has more than {MAX_GRAMS + 1} words: {text[:40]}")
            rows += [(f"{label}:{text}", label, len(ws) - GRAM + 1, phrase, i, ws[i], ws[i + 1]) for i in range(len(ws) - 1)]
    grams = spark.createDataFrame(rows, "template string, label string, grams int, phrase boolean, offset int, a string, b string")
    return grams.select("template", "label", "grams", "phrase", "offset", gram_hash(F.col("a"), F.col("b")).alias("gram"))


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans for each row of docs.

    spans: array of (label, first, last, share) of the verified spans. The templates are bounded by the caller's list
    and broadcast; only matching k-grams and one short row for each document are shuffled.
    """
    spark = docs.sparkSession
    split = docs.select(F.col(id).alias("i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), words(F.col(text)).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda p: gram_hash(F.element_at("w", p), F.element_at("w", p + 1)))
    rolled = split.where(F.size("w") >= GRAM).select("i", "t", F.posexplode(grams).alias("at", "gram"))
    votes = rolled.join(F.broadcast(template_grams(spark, templates, phrases)), "gram")
    diagonals = votes.groupBy("i", "t", "template", "label", "grams", "phrase", (F.col("at") - F.col("offset")).alias("diagonal")).agg(
        # Rows that repeat an id and text vote together: places are marked once.
        F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    diagonals = checkpointed(diagonals.withColumn("votes", F.bit_count("mask")))
    whole = diagonals.where("phrase and votes = grams").select("i", "t", "label", "diagonal")
    base = whole.groupBy("i", "t").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    # A template whose votes are too few on all diagonals of a text together can't have a span there. What is left is
    # spread over windows of MAX_SHIFT + 1 neighbouring diagonals; both steps and the sums share one shuffle.
    total = F.sum("votes").over(Window.partitionBy("i", "t", "template"))
    likely = diagonals.where(f"not phrase and grams >= {SHORT}").withColumn("total", total).where(F.col("total") >= MIN_SHARE * F.col("grams")).drop("total")
    spread = likely.select("*", F.explode(F.sequence(F.col("diagonal") - MAX_SHIFT, F.col("diagonal"))).alias("anchor"))
    merged = spread.groupBy("i", "t", "label", "grams", "template", "anchor").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.least(F.bit_count("mask"), F.col("last") - F.col("first") + 1) / F.col("grams")
    good = merged.withColumn("share", share).where(F.col("share") >= MIN_SHARE).select("i", "t", "label", "first", "last", "share")
    short = diagonals.where(f"not phrase and grams < {SHORT} and votes = grams").select("i", "t", "label", "first", "last", F.lit(1.0).alias("share"))
    spans = good.unionByName(short).groupBy("i", "t", "label", "first", "last").agg(F.max("share").alias("share"))
    verified = spans.groupBy("i", "t").agg(F.array_sort(F.collect_list(F.struct("label", "first", "last", "share"))).alias("spans"), F.max("share").alias("best"))
    # One row for each id and text; a full join would hold a null id's two halves apart.
    halves = base.unionByName(verified, allowMissingColumns=True).groupBy("i", "t")
    known = halves.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n_base", "first_word", "last_word", "base_set", "spans", "best")])
    out = split.select("i", "t", F.size("w").cast("long").alias("n_words")).join(known.withColumnsRenamed({"i": "_i", "t": "_t"}), (F.col("t") == F.col("_t")) & F.col("i").eqNullSafe(F.col("_i")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_union(F.coalesce("base_set", none), F.coalesce(F.transform("spans", lambda s: s["label"]), none))
    return out.select(
        F.col("i").alias(id), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base_set", none)), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans",
    )


def oracle_sql(templates=TEMPLATES, phrases=PHRASES) -> str:
    """The scan in SQL of DuckDB, with the words themselves in place of hashes; ids must be unique."""
    grams = []
    for phrase, entries in ((True, phrases), (False, templates)):
        for text, label in entries:
            ws = re.findall(WORD, text.lower())
            grams += [f"('{label}:{text}', '{label}', {len(ws) - GRAM + 1}, {phrase}, {i}, '{ws[i]}', '{ws[i + 1]}')" for i in range(len(ws) - 1)]
    return rf"""
WITH grams(template, label, grams, phrase, off, a, b) AS (VALUES {", ".join(grams)}),
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
rolled AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:], range(len(w) - 1))) AS g FROM split WHERE len(w) >= 2),
votes AS (SELECT doc_id, template, label, grams, phrase, off, g[3] - off AS diagonal, g[3] AS pos FROM rolled JOIN grams ON g[1] = a AND g[2] = b),
diagonals AS (
  SELECT doc_id, template, label, grams, phrase, diagonal, count(*) AS votes FROM votes GROUP BY ALL),
base AS (
  SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base_set
  FROM diagonals WHERE phrase AND votes = grams GROUP BY doc_id),
merged AS (
  SELECT doc_id, label, grams, template, anchor, least(count(DISTINCT off), max(pos) - min(pos) + 1) / grams AS share FROM (
    SELECT *, unnest(range(diagonal - {MAX_SHIFT}, diagonal + 1)) AS anchor FROM votes WHERE NOT phrase AND grams >= {SHORT}) GROUP BY doc_id, label, grams, template, anchor),
good AS (
  SELECT doc_id, label, share FROM merged WHERE share >= {MIN_SHARE}
  UNION ALL SELECT doc_id, label, 1.0 FROM diagonals WHERE NOT phrase AND grams < {SHORT} AND votes = grams),
spans AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS best FROM good GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base_set, []::VARCHAR[])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []::VARCHAR[]), coalesce(more, []::VARCHAR[])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM split LEFT JOIN base USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


ORACLE_SQL = oracle_sql()

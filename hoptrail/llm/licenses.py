"""License scans by diagonal voting: word k-grams meet template places by a join, offsets vote, neighbours merge, spans verify."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASE_GRAM, PASSAGE_GRAM = 2, 4
SHIFT = 4       # diagonals this near may belong to one copy with words put in or left out
GAP = 12        # words between two parts of one copy at most
SHARE = 0.6     # of a passage's k-grams that a copy shows at least
MOST_GRAMS = 63  # of one template: they are the bits of a mask

# Phrases that name a license.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

# Sentences of common license notices (label, text).
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
            "warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]


def template_grams(phrases=None, passages=None) -> list[tuple]:
    """(template, label, base, length, n_grams, spot, w0, w1, w2, w3) for each k-gram of each template; a phrase's k-grams have
    two words, a passage's four."""
    out = []
    for base, k, given in ((True, PHRASE_GRAM, PHRASES if phrases is None else phrases),
                           (False, PASSAGE_GRAM, PASSAGES if passages is None else passages)):
        for label, text in given:
            words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
            n = len(words) - k + 1
            if not 1 <= n <= MOST_GRAMS:
                raise ValueError(f"a template needs {k} to {MOST_GRAMS + k - 1} words: {text!r}")
            number = len({row[0] for row in out})
            out += [(number, label, base, len(words), n, at, *(words[at:at + k] + [None] * (4 - k))) for at in range(n)]
    return out


def _values(phrases, passages) -> str:
    """The templates as SQL."""
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return "(VALUES " + ", ".join(
        "(" + ", ".join([str(r[0]), text(r[1]), str(r[2]).lower(), *map(str, r[3:6]), *map(text, r[6:])]) + ")"
        for r in template_grams(phrases, passages)) + ") AS t(template, label, base, length, n_grams, spot, t0, t1, t2, t3)"


def _templates(spark: SparkSession, phrases, passages) -> DataFrame:
    return spark.sql(f"SELECT *, xxhash64(t0, t1, t2, t3) AS hash, shiftleft(1L, spot) AS bit FROM {_values(phrases, passages)}")


def _text(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def votes(docs: DataFrame, phrases=None, passages=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Diagonals of templates in texts: doc_id, name (hash of the text), template, label, base, length, n_grams, diagonal (word
    of the text at which the template would start), mask (its k-grams found there, a bit each), lo and hi (first and last
    place of a found k-gram).

    Every rolling k-gram of every text is hashed and joined to the k-grams of the templates (a fixed table of some hundred
    rows, broadcast); the words themselves are compared in the same join. Rows that repeat an id and text set the same bits.
    """
    words = F.regexp_extract_all(_text("text"), F.lit(WORD), F.lit(0))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    d = d.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("name"), words.alias("_w"))
    later = [F.slice("_w", k + 1, F.greatest(F.size("_w"), F.lit(1))).alias(f"w{k}") for k in range(1, PASSAGE_GRAM)]
    d = d.select("doc_id", "name", F.posexplode(F.arrays_zip(F.col("_w").alias("w0"), *later)).alias("pos", "g"))
    w = [F.col("g")[f"w{k}"].alias(f"w{k}") for k in range(PASSAGE_GRAM)]
    d = d.select("doc_id", "name", "pos", *w).where("w1 IS NOT NULL")
    both = F.array(F.xxhash64("w0", "w1"), F.xxhash64("w0", "w1", "w2", "w3"))
    d = d.select("*", F.explode(both).alias("hash"))
    t = F.broadcast(_templates(docs.sparkSession, phrases, passages))
    same = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (
        F.col("t2").isNull() | ((F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))))
    met = d.join(t, (d["hash"] == t["hash"]) & same)
    return met.groupBy("doc_id", "name", "template", "label", "base", "length", "n_grams", (F.col("pos") - F.col("spot")).alias("diagonal")).agg(
        F.bit_or("bit").alias("mask"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def spans(found: DataFrame, share: float = SHARE) -> DataFrame:
    """Copies of templates from ``votes``: doc_id, name, template, label, base, start, end (words, end excluded), share (of the
    template's k-grams) and verified.

    A phrase is verified where all its words stand on one diagonal. Diagonals of a passage merge, in the order of their
    places, while they stay within ``SHIFT`` of the one before and start at most ``GAP`` words after its end; the merged
    copy is verified from ``share`` of the passage's k-grams on.
    """
    w = W.partitionBy("doc_id", "name", "template").orderBy("lo", "diagonal")
    new = F.lag("hi").over(w).isNull() | (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > SHIFT) | (
        F.col("lo") - F.lag("hi").over(w) > GAP)
    p = found.where("NOT base").withColumn("_new", new.cast("int"))
    p = p.withColumn("_part", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    p = p.groupBy("doc_id", "name", "template", "label", "base", "n_grams", "_part").agg(
        F.min("lo").cast("long").alias("start"), (F.max("hi") + PASSAGE_GRAM).cast("long").alias("end"), F.bit_or("mask").alias("mask"))
    part = F.bit_count("mask") / F.col("n_grams")
    p = p.select("doc_id", "name", "template", "label", "base", "start", "end", part.alias("share"), (part >= share).alias("verified"))
    b = found.where("base").where(F.bit_count("mask") == F.col("n_grams")).select(
        "doc_id", "name", "template", "label", "base", F.col("diagonal").cast("long").alias("start"),
        (F.col("diagonal") + F.col("length")).cast("long").alias("end"), F.lit(1.0).alias("share"), F.lit(True).alias("verified"))
    return b.unionByName(p)


def scan(docs: DataFrame, phrases=None, passages=None, share: float = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licenses of whole texts: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row.

    Base places are those of the phrases (all of them; also inside passages); labels adds those of verified passages. The
    score is the largest share of a template that was found, 1 for a phrase, 0 without any. Words are lower-cased (A to Z
    only) runs of digits, letters and everything beyond ASCII. A null text is an empty one; rows without an id, with another
    row's id or repeated ones all get their own text's result; an empty table gives no rows. The words of one text stand in
    one array (some 40 bytes a word), which is the limit to a text's length.
    """
    found = spans(written(votes(docs, phrases, passages, doc_id, text), "license-votes"), share)
    base = F.col("base")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    hits = found.groupBy(F.col("doc_id").alias("_id"), F.col("name").alias("_name")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), names(base).alias("base_labels"),
        names(F.col("verified")).alias("labels"), F.max("share").alias("score"))
    whole = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("name"),
        F.regexp_count(_text(text), F.lit(WORD)).cast("long").alias("n_words"))
    return whole.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("name") == F.col("_name")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def scan_sql(phrases=None, passages=None, share: float = SHARE) -> str:
    """The scan of ``documents`` in SQL."""
    return rf"""
WITH t AS (SELECT * FROM {_values(phrases, passages)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT r, w, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
v AS (SELECT r, template, label, base, length, n_grams, pos - spot AS diagonal, bit_or(1::BIGINT << spot) AS mask, min(pos) AS lo,
        max(pos) AS hi
      FROM g JOIN t ON w[pos + 1] = t0 AND w[pos + 2] = t1 AND (t2 IS NULL OR (w[pos + 3] = t2 AND w[pos + 4] = t3))
      GROUP BY ALL),
n AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= {SHIFT} AND lo - lag(hi) OVER o <= {GAP} THEN 0 ELSE 1 END AS new
      FROM v WHERE NOT base WINDOW o AS (PARTITION BY r, template ORDER BY lo, diagonal)),
m AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY lo, diagonal ROWS UNBOUNDED PRECEDING) AS part FROM n),
s AS (SELECT r, label, false AS base, NULL::BIGINT AS start, bit_count(bit_or(mask)) / n_grams::DOUBLE AS share
      FROM m GROUP BY r, template, label, n_grams, part
      UNION ALL SELECT r, label, true, diagonal, 1.0 FROM v WHERE base AND bit_count(mask) = n_grams),
h AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) AS first_word, max(start) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= {share}) AS labels, max(share) AS score
      FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN h USING (r)"""

"""Operator 11: license phrases and notices in whole texts, by votes of word k-grams on offset diagonals.

1. All rolling word pairs and word triples of a text are hashed and joined with
   the positions of the same grams in the templates.  A join hit counts only if
   the words themselves are equal.
2. A hit at word p of the text and word q of a template votes for the diagonal
   p - q: the word at which the template would begin.
3. Diagonals at most REACH apart vote together, so words put in or left out
   don't split a copy.  A place is verified when these votes cover the
   template's share of different grams: all for a phrase, which must stand as
   it is, and NOTICE_SHARE for a notice.  Neighbouring verified diagonals are
   one place.

Everything is DataFrame functions.  Only the templates (a fixed list) are
broadcast; of a text, only its hits and one row with its size are shuffled.

Defined cases: null or blank text has no words, no places, empty labels and the
score 0; repeated rows give repeated results; ids may repeat or be null, a row
is known by its id and two hashes of its text; long texts are scanned whole;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covercost.llm.base import table

# The phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices that licenses ask to be put into files, by label.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
     "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at", "mpl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
)
#: Words of a gram of phrases and of notices.
PHRASE_K, NOTICE_K = 2, 3
#: Share of a notice's grams that a place covers, and how far apart (in words) diagonals vote together.
NOTICE_SHARE, REACH = 0.6, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Template number of the row that stands for a text itself.
TEXT = -1
KEY = ("doc_id", "_h1", "_h2", "_part")


def templates() -> list[tuple[int, str, bool, list[str], int, int]]:
    """(number, label, whether a phrase, words, words of a gram, different grams that a place must cover)."""
    out = []
    for text, label in (*PHRASES, *NOTICES):
        words, phrase = [w for w in re.split(BETWEEN, text.lower()) if w], len(out) < len(PHRASES)
        k = PHRASE_K if phrase else NOTICE_K
        grams = len(words) - k + 1
        out.append((len(out), label, phrase, words, k, grams if phrase else math.ceil(NOTICE_SHARE * grams)))
    return out


def gram_hash(k: int, *words):
    return F.xxhash64(F.lit(k), *words)


def from_word(k: int):
    """The hash of the ``k`` words of ``_w`` from one on (of fewer at the end, which is no gram's hash)."""
    return lambda word, i: gram_hash(k, word, *(F.get("_w", i + j) for j in range(1, k)))


def positions(spark: SparkSession) -> DataFrame:
    """A row for each gram of each template: its hash, words, template and position; and one for the texts themselves."""
    names = ("template", "label", "phrase", "words", "k", "need")
    rows = [*templates(), (TEXT, None, False, [], 0, 1)]
    fixed = F.array(*(F.struct(*(literal(v).alias(c) for c, v in zip(names, row, strict=True))) for row in rows))
    t = spark.range(1).select(F.inline(fixed))  # built in the JVM
    t = t.select("template", "label", "phrase", "k", "need", F.greatest(F.size("words") - F.col("k") + 1, F.lit(1)).alias("grams"), "words")
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("q"))
    t = t.withColumn("gram", F.slice("words", F.col("q") + 1, "k")).drop("words")
    own = {k: gram_hash(k, *(F.get("gram", i) for i in range(k))) for k in (PHRASE_K, NOTICE_K)}
    return t.withColumn("hash", F.when(F.col("k") == 0, F.lit(0)).when(F.col("k") == PHRASE_K, own[PHRASE_K]).otherwise(own[NOTICE_K]))


def literal(value):
    if isinstance(value, list):
        return F.array(*map(F.lit, value)).cast("array<string>")
    return F.lit(value).cast("string") if value is None else F.lit(value)


def hits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Equal grams of texts and templates, with the word ``p`` of the text; and one row a text with template TEXT."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    # lower() makes an ASCII word of a word that isn't one only where the Kelvin sign stands
    low = F.when(F.instr("_t", "\u212a") > 0, F.translate("_t", UPPER, LOWER)).otherwise(F.lower("_t"))
    d = d.select("doc_id", F.xxhash64("_t").alias("_h1"), F.xxhash64(F.lit(1), "_t").alias("_h2"), F.spark_partition_id().alias("_part"), F.array_remove(F.split(low, BETWEEN), "").alias("_w"))
    rolling = [F.transform("_w", from_word(k)) for k in (PHRASE_K, NOTICE_K)]
    d = d.select(*KEY, "_w", F.size("_w").alias("n_words"), F.concat(F.array(F.lit(0).cast("long")), *rolling).alias("_grams"))
    d = d.select(*KEY, "_w", "n_words", F.posexplode("_grams").alias("_at", "hash"))
    d = d.join(F.broadcast(positions(spark)), "hash")
    # the array: the text's own entry, the pairs of all words, the triples of all words
    p = F.col("_at") - 1 - F.when(F.col("k") == NOTICE_K, F.col("n_words")).otherwise(0)
    d = d.withColumn("p", F.when(F.col("k") > 0, p).otherwise(0))
    own, equal = (F.col("_at") == 0) & (F.col("k") == 0), (F.col("_at") > 0) & (F.col("k") > 0) & (F.col("p") >= 0)
    return d.where(own | (equal & (F.slice("_w", F.greatest("p", F.lit(0)) + 1, F.greatest("k", F.lit(1))) == F.col("gram")))).select(
        *KEY, "n_words", "template", "label", "phrase", "need", "grams", "q", (F.col("p") - F.col("q")).alias("diagonal"))


def places(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Verified places (key of the text, template, label, phrase, first_word, score), and one row a text with template TEXT and its number of equal rows."""
    h = hits(spark, docs).repartition(*KEY)
    votes = h.groupBy(*KEY, "n_words", "template", "label", "phrase", "need", "grams", "diagonal").agg(F.count("*").alias("copies"), F.collect_set("q").alias("covers"))
    along = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    near = F.size(F.array_distinct(F.flatten(F.collect_list("covers").over(along.rangeBetween(-REACH, REACH)))))
    votes = votes.withColumn("covered", F.when(F.col("phrase") | (F.col("template") == TEXT), F.size("covers")).otherwise(near))
    votes = votes.where("covered >= need")
    apart = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > REACH, F.lit(True))
    votes = votes.withColumn("place", F.sum(apart.cast("int")).over(along))
    return votes.groupBy(*KEY, "n_words", "template", "label", "phrase", "place").agg(
        F.max("copies").alias("copies"), F.min("diagonal").alias("first_word"), (F.max("covered") / F.max("grams")).alias("score"))


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best share of a template's grams, 0 without any)."""
    found, base = F.col("template") != TEXT, F.col("phrase")
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = places(spark, docs).groupBy(*KEY).agg(
        F.max("n_words").cast("long").alias("n_words"), F.max(F.when(~found, F.col("copies"))).alias("_copies"),
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"), labels(base).alias("base_labels"), labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("score"))), F.lit(0.0)).alias("score"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", copies).drop("_copy")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def oracle() -> str:
    rows = ", ".join(f"({t}, '{label}', {str(phrase).lower()}, '{' '.join(words)}', {k}, {need}, {len(words) - k + 1})" for t, label, phrase, words, k, need in templates())
    gram = "array_to_string(list_slice(w, p + 1, p + k), ' ')"
    return rf"""
    with tpl as (select *, string_split(words, ' ') w from (values {rows}) x(template, label, phrase, words, k, need, grams)),
    tg as (select template, k, p q, {gram} gram from (select template, k, w, unnest(range(0, grams)) p from tpl)),
    t as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
    g as (select rid, k, p, {gram} gram from (select rid, w, k, unnest(range(0, len(w) - k + 1)) p from t, (values ({PHRASE_K}), ({NOTICE_K})) s(k) where len(w) >= k)),
    h as (select distinct rid, template, q, p - q diagonal from g join tg using (k, gram)),
    dg as (select distinct rid, template, diagonal from h),
    v as (select dg.rid, dg.template, dg.diagonal, count(distinct h.q) covered
          from dg join tpl using (template) join h on dg.rid = h.rid and dg.template = h.template
            and abs(h.diagonal - dg.diagonal) <= case when phrase then 0 else {REACH} end group by all),
    f as (select rid, label, phrase, diagonal, covered / grams score from v join tpl using (template) where covered >= need),
    a as (select rid, count(*) filter (phrase) n_base, min(diagonal) filter (phrase) first_word, max(diagonal) filter (phrase) last_word,
                 string_agg(distinct label, ',' order by label) filter (phrase) base_labels, string_agg(distinct label, ',' order by label) labels, max(score) score
          from f group by rid)
    select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
           coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::double score
    from t left join a using (rid)"""

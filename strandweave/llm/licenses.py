"""License scans by diagonal voting.

Every rolling word k-gram of a text is joined to the k-grams of the license templates; a hit at text place x and
template place y votes for the diagonal x - y. Votes are counted per text, template and diagonal, neighbouring diagonals of a long template
are merged (a word more or less in the text moves the rest to the next diagonal), and spans are verified: each hit compares the words
themselves, and a span must cover enough of its template.

Base templates are short phrases, found in full: every pair of neighbouring words must vote on one diagonal. Notices are longer and
found from ``COVER`` of their five-word grams on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening words of public license notices and their labels.
NOTICES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    "This is free and unencumbered software released into the public domain": "unlicense",
}

GRAM = 5
COVER = 0.6
#: Diagonals that lie at most so far apart belong to one span of a notice.
BAND = 3
#: Places of all templates together up to which they are broadcast.
BROADCAST_PLACES = 100_000
_DOC = -1


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _hashes(words: str) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _grams(hashes: str, k: int) -> Column:
    """Hash of the k words' hashes from each place (of fewer at the end, which no template has)."""
    return F.transform(hashes, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(F.col(hashes), i + j) for j in range(1, k)]))


def _templates(spark, base: dict, notices: dict) -> tuple[DataFrame, DataFrame, int]:
    rows, info = [], []
    for phrase, label, is_base in [*((p, x, True) for p, x in base.items()), *((p, x, False) for p, x in notices.items())]:
        w = words_of(phrase)
        k = 2 if is_base else GRAM
        if len(w) < k:
            raise ValueError(f"{phrase!r} has under {k} words")
        info.append((len(info), label, is_base, len(w) - k + 1))
        rows += [(info[-1][0], y, k, w[y : y + k]) for y in range(len(w) - k + 1)]
    t = spark.createDataFrame(rows, "template int, y int, k int, gram array<string>")
    # the same expression as for texts, so that equal words have equal hashes
    gram = lambda k: F.xxhash64(F.lit(k), *[F.xxhash64(F.get("gram", F.lit(j))) for j in range(k)])
    t = t.withColumn("hash", F.when(F.col("k") == 2, gram(2)).otherwise(gram(GRAM)))
    # the text itself: one row that every text has, so that no second pass or join is needed
    doc = spark.createDataFrame([(_DOC, 0, 0, [])], "template int, y int, k int, gram array<string>").withColumn("hash", F.lit(_DOC).cast("long"))
    return t.unionByName(doc), spark.createDataFrame(info, "template int, label string, is_base boolean, grams int"), len(rows) + 1


def scan(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES) -> DataFrame:
    """One row per span: (doc_id, text_key, template, start, votes, grams, label, is_base), and one per text with
    template -1, votes: rows with that doc_id and text, start: its words."""
    spark = docs.sparkSession
    templates, info, places = _templates(spark, base, notices)
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    texts = docs.select("doc_id", text_key("text").alias("text_key"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    grams = F.concat(F.array(F.lit(_DOC).cast("long")), _grams("hashes", 2), _grams("hashes", GRAM))
    # grams are a column of their own before they are exploded: with lambdas inside it, explode would leave generated code and
    # copy all words for every row; the outer form (no array is empty) keeps Spark from inferring a filter that would make them twice
    made = texts.withColumn("hashes", _hashes("words")).withColumn("grams", grams)
    rolled = made.select("doc_id", "text_key", "words", F.posexplode_outer("grams").alias("at", "hash"))
    small = F.broadcast(templates) if places <= BROADCAST_PLACES else templates
    hits = rolled.join(small, "hash").withColumn("x", F.when(F.col("template") == _DOC, n).otherwise((F.col("at") - 1) % F.greatest(n, F.lit(1))))
    hits = hits.where((F.col("template") == _DOC) | (F.slice("words", F.col("x") + 1, F.col("k")) == F.col("gram")))
    hits = hits.select("doc_id", "text_key", "template", F.when(F.col("template") == _DOC, F.lit(0)).otherwise(F.col("x") - F.col("y")).alias("diagonal"), "x")
    # rows with the same doc_id and text vote alike: count places, not rows
    once = hits.groupBy("doc_id", "text_key", "template", "diagonal", "x").agg(F.count("*").alias("rows"))
    votes = once.groupBy("doc_id", "text_key", "template", "diagonal").agg(F.count("*").alias("votes"), F.max("rows").alias("rows"), F.max("x").alias("last"))
    votes = votes.join(F.broadcast(info), "template", "left")
    own = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > F.when(F.col("is_base"), 0).otherwise(BAND), F.lit(True))
    merged = votes.withColumn("span", F.sum(apart.cast("int")).over(own)).groupBy("doc_id", "text_key", "template", "label", "is_base", "grams", "span")
    merged = merged.agg(F.sum("votes").alias("votes"), F.max("rows").alias("rows"), F.min("diagonal").alias("start"), F.max("last").alias("last"))
    full = F.when(F.col("is_base"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") >= COVER * F.col("grams"))
    return merged.where((F.col("template") == _DOC) | full)


def licenses(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``.

    Words: ``WORD`` of the whole text, A-Z lower-cased; null counts as empty. n_base: places of base phrases; first_word, last_word:
    the smallest and largest start of one, null without; labels: those of base phrases and notices. score: 1 with a base phrase, else
    the largest covered share of a notice, else 0. Rows with the same doc_id and text give the same row each.
    """
    s = scan(docs, base, notices)
    is_doc, is_base = F.col("template") == _DOC, F.coalesce("is_base", F.lit(False))
    joined = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    out = s.groupBy("doc_id", "text_key").agg(
        F.max(F.when(is_doc, F.col("rows"))).alias("rows"),
        F.max(F.when(is_doc, F.col("last"))).cast("long").alias("n_words"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(~is_doc).alias("labels"),
        F.coalesce(F.max(F.when(is_base, F.lit(1.0)).when(~is_doc, F.least(F.lit(1.0), F.col("votes") / F.col("grams")))), F.lit(0.0)).alias("score"),
    )
    again = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    return again.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

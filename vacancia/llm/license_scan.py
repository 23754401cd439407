"""License scans by diagonal voting.

All rolling ``k``-word hashes of the documents are joined with the positions of the same hashes in the templates. Hits of one
document and template are counted by diagonal (document position less template position); neighbouring diagonals, as left
by a few inserted or dropped words, are merged; a merged vote is verified by the share of the template's words found
in order of the diagonal within its span. Labels of verified spans join those of the base phrases.

The templates are a fixed table, so the join broadcasts them. Null texts are empty. Repeated rows share one result. Rows without
doc_id are scanned like others. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keyed, same

#: Letters and digits of ASCII, and everything beyond ASCII. lower() also changes letters beyond ASCII, which moves no word border, and none of them
#: becomes a letter of the base phrases.
LICENSE_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
# Phrases whose places are counted, and their labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# Sentences of public licenses, one or more per label.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]


def places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand one after another."""
    parts = phrase.split()
    n = F.size(words)

    def here(i):
        hit = F.get(words, i) == parts[0]
        for j, w in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + j) == w)
        return hit
    known = None
    for w in parts:
        known = F.array_contains(words, w) if known is None else known & F.array_contains(words, w)
    return F.when(known & (n >= len(parts)), F.filter(F.sequence(F.lit(0), n - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def template_table(spark, k: int) -> DataFrame:
    """(template, label, length, tpos, gram): every k-gram of every template; the table is fixed and small."""
    rows = [(number, label, len(text.split()), text) for number, (label, text) in enumerate(TEMPLATES)]
    given = spark.createDataFrame(rows, "template int, label string, length int, line string").withColumn("tw", F.split("line", " "))
    return given.select("template", "label", "length", F.posexplode(grams(F.col("tw"), k)).alias("tpos", "gram"))


def grams(words: Column, k: int) -> Column:
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def spans(docs: DataFrame, k: int = 4, drift: int = 3, least: float = 0.75) -> DataFrame:
    """(doc_id, text_key, label, template, start, end, coverage): verified spans in words.

    ``least``: share of the template's k-grams, on merged diagonals and counted once each, that a span must hold.
    """
    words = keyed(docs).select("doc_id", "text_key", F.regexp_extract_all(F.lower("text"), F.lit(LICENSE_WORD), F.lit(1)).alias("w"))
    hits = (words.select("doc_id", "text_key", F.posexplode(grams(F.col("w"), k)).alias("pos", "gram"))
            .join(F.broadcast(template_table(docs.sparkSession, k)), "gram"))
    votes = (hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
             .groupBy("doc_id", "text_key", "template", "label", "length", "diagonal")
             .agg(F.collect_set("tpos").alias("at")))
    # neighbouring diagonals (steps of at most ``drift``) are islands of one document and template
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    islands = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int")) \
        .withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    merged = (islands.groupBy("doc_id", "text_key", "template", "label", "length", "island")
              .agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
                   F.min(F.col("diagonal") + F.array_min("at")).alias("start"), F.max(F.col("diagonal") + F.array_max("at")).alias("last")))
    found = merged.withColumn("coverage", F.size("at") / (F.col("length") - k + 1))
    # verified: enough of the template, and no more words than it has and the drift allows
    ok = (F.col("coverage") >= least) & (F.col("last") + k - F.col("start") <= F.col("length") + drift)
    return found.filter(ok).select("doc_id", "text_key", "label", "template", F.col("start").cast("long"), (F.col("last") + k).cast("long").alias("end"), "coverage")


def scanned(docs: DataFrame, k: int = 4, drift: int = 3, least: float = 0.75) -> DataFrame:
    """Per row: doc_id, text_key, n_words, places per base label, ``found`` (verified spans)."""
    base = keyed(docs).withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(LICENSE_WORD), F.lit(1)))
    base = base.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"),
                       *[places(F.col("w"), phrase).alias(f"p{i}") for i, phrase in enumerate(PHRASES.values())])
    found = spans(docs, k, drift, least).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(
        F.struct("start", "end", "label", "coverage"))).alias("found"))
    return same(base, found, ["doc_id", "text_key"], "left")


def digest(docs: DataFrame, **options) -> DataFrame:
    got = scanned(docs, **options)
    ps = [F.col(f"p{i}") for i in range(len(PHRASES))]
    all_places = F.concat(*ps)
    # the score is the best evidence: a phrase counts half, a verified span its coverage
    spans_ = F.coalesce("found", F.array().cast("array<struct<start:bigint,end:bigint,label:string,coverage:double>>"))
    base = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in zip(PHRASES, ps)]), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform(spans_, lambda s: s["label"]))))
    score = F.greatest(F.when(F.size(all_places) > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform(spans_, lambda s: s["coverage"])), F.lit(0.0)))
    return got.select("doc_id", "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"),
                      F.array_max(all_places).cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"), F.least(score, F.lit(1.0)).cast("double").alias("score"))

"""License scans by diagonal voting.

Hashes of all rolling word k-grams of the documents are joined to the positions that they have in templates; grams whose
words differ in spite of equal hashes are dropped, so votes are exact. Document position less template position is the
diagonal: grams of one copy share it. Votes are summed by diagonal. Insertions and deletions move later grams to diagonals
nearby: all diagonals of a template are sorted, and those that follow each other within half its length are one copy,
whatever other grams stand between. Merged spans are verified by the share of template words that their grams cover.

Templates of kind `phrase` are the base: a span counts where every word stands, on a single diagonal. Templates of kind
`notice` add labels of the method's own where at least `MIN_COVER` of the words are found.

Defined cases: null texts have no words; equal (doc_id, text) rows give one row; equal ids with different texts give a
row each; an empty table gives no rows; a document without a match has empty labels and score zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.common import materialized, words
from lumenlake.llm.grams import neighbours, shingles, tokenised

K = 3
#: Diagonals that lie so many template lengths apart are one copy with insertions or deletions.
NEAR = 0.5
MIN_COVER = 0.8

# Phrases that name a licence, by label.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Sentences of public licence texts and notices, by label.
NOTICES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Released under the MIT License",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "gpl-3": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "gpl-2": ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License"),
    "cc-by": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
}


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, n, at, gram, w0, w1, w2): every gram position of every template; bounded by the lists above."""
    rows = [(label, True, text) for label, text in PHRASES.items()]
    rows += [(label, False, text) for label, texts in NOTICES.items() for text in texts]
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, label string, phrase boolean, text string")
    keep = ("template", "label", "phrase", "n")
    places = neighbours(listed.withColumn("words", words(F.col("text"))).withColumn("n", F.size("words")), *keep)
    return shingles(places, [K], *keep, "w0", "w1", "w2").drop("k").withColumnRenamed("pos", "at")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, phrase, first, last, cover): verified copies; words first to last."""
    known = F.broadcast(templates(docs.sparkSession)).alias("t")  # a few hundred rows
    keep = ("doc_id", "text_hash")
    held = shingles(neighbours(tokenised(docs), *keep), [K], *keep, "w0", "w1", "w2").alias("h")
    same = F.expr("h.gram = t.gram AND h.w0 = t.w0 AND h.w1 = t.w1 AND h.w2 = t.w2")
    votes = held.join(known, same).select("doc_id", "text_hash", "template", "label", "phrase", "n", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    key = ["doc_id", "text_hash", "template", "label", "phrase", "n"]
    lines = votes.groupBy(*key, "diagonal").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("at")
    )
    # Base: all grams of the phrase on one diagonal are all its words, each in its place. Each counts once, as rows repeat.
    exact = lines.filter(F.col("phrase") & (F.size("at") == F.col("n") - K + 1)).select(
        *key, F.col("first").cast("long"), (F.col("last") + K - 1).cast("long").alias("last"), F.lit(1.0).alias("cover")
    )
    over = "(PARTITION BY doc_id, text_hash, template ORDER BY diagonal)"
    merged = (
        lines.filter("NOT phrase")
        .selectExpr("*", f"CASE WHEN diagonal - lag(diagonal) OVER {over} <= {NEAR} * n THEN 0 ELSE 1 END AS new")
        .selectExpr("*", f"sum(new) OVER {over} AS copy")
        .groupBy(*key, "copy")
        .agg(F.min("first").cast("long").alias("first"), (F.max("last") + K - 1).cast("long").alias("last"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    )
    # Verify: words of the template inside equal grams, each counted once.
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + K - 1)))))
    verified = merged.withColumn("cover", covered / F.col("n")).filter(F.col("cover") >= MIN_COVER)
    return exact.unionByName(verified.select(*key, "first", "last", "cover")).drop("n")


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover)."""
    found = materialized(spans(docs), "license-spans")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    marks = found.groupBy("doc_id", "text_hash").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("cover").alias("score"),
    )
    sized = tokenised(docs).select("doc_id", "text_hash", "n_words").distinct()
    s, m = sized.alias("s"), marks.alias("m")
    return s.join(m, F.expr("s.doc_id <=> m.doc_id AND s.text_hash = m.text_hash"), "left").select(
        "s.doc_id",
        "s.text_hash",
        "s.n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. A window is
contained exactly, so of its shingles in order of rarity the prefix is one long: the shingle that stands in the fewest
places, counted over all documents. Only that one is joined to documents; its places give candidates; bounds on length
and position drop those that don't fit the document; then the window's words must stand there.

Texts are split into words once and written; counting and joining read them. Windows are broadcast, in blocks where
there are many, so common shingles aren't shuffled.

Defined cases: null texts have no words; an item without words has no window; equal items are counted each; rows that
repeat (doc_id, text) give one row; equal ids with different texts give a row each; extra columns are ignored. An empty
`documents` gives no rows, an empty `benchmark` no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import materialized, with_key, words
from lumenlake.llm.grams import LONGEST, blocks, neighbours, shingles, tokenised

WIDTH = 10


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, n, k, words, window): the windows of every item, n words each, in shingles of k words."""
    parted = benchmark.select("item_id", words(F.col("text")).alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - width + 1))
    cut = parted.select(
        "item_id", F.least(F.size("t"), F.lit(width)).alias("n"), F.explode(F.transform(starts, lambda i: F.slice("t", i, width))).alias("words")
    )
    return cut.select("item_id", "n", F.least("n", F.lit(LONGEST)).alias("k"), "words", F.array_join("words", " ").alias("window"))


def _grams(distinct: DataFrame, sizes: list[int]) -> DataFrame:
    """(window, n, k, at, gram): the shingles of windows, and where they stand in them."""
    keep = ("window", "n", F.col("k").alias("of"))
    found = shingles(neighbours(distinct.select(*keep, "words"), "window", "n", "of"), sizes, "window", "n", "of")
    return found.filter("k = of").select("window", "n", "k", F.col("pos").alias("at"), "gram")


def occurrences(parted: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int | None = None) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n): every place of parted(doc_id, text_hash, words, n_words) where a window
    of benchmark(item_id, text) stands. Reads `parted` twice."""
    limit = {"limit": block} if block else {}
    asked = materialized(windows(benchmark, width), "windows")
    sizes = sorted(r.k for r in asked.select("k").distinct().collect())
    if not sizes:
        return parted.select("doc_id", "text_hash", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n")).limit(0)
    grams = materialized(_grams(asked.dropDuplicates(["window"]), sizes), "window-grams")
    places = shingles(neighbours(parted.select("words")), sizes)
    counted = [places.join(known, ["k", "gram"], "left_semi").groupBy("k", "gram").agg(F.count("*").alias("places")) for known in blocks(grams.select("k", "gram").distinct(), "gram", **limit)]
    rarity = materialized(reduce(DataFrame.unionByName, counted), "rarity")
    first = materialized(
        grams.join(rarity, ["k", "gram"], "left")
        .groupBy("window", "n", "k")
        .agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "gram", "at")).alias("rarest"))
        .filter("rarest.places > 0")  # a shingle that no document holds rules its window out
        .select("window", "n", "k", "rarest.gram", "rarest.at"),
        "prefixes",
    )
    keep = ("doc_id", "text_hash", "n_words", "words")
    held = shingles(neighbours(parted.select(*keep), *keep), sizes, *keep)
    found = [
        held.join(known, ["k", "gram"])
        .withColumn("start", F.col("pos") - F.col("at"))
        .filter("start >= 0 AND start + n <= n_words")
        .filter(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("window"))
        .select("doc_id", "text_hash", "window", "start", "n")
        for known in blocks(first, "gram", **limit)
    ]
    items = asked.select("window", "item_id").distinct()
    return reduce(DataFrame.unionByName, found).join(items, "window").select("doc_id", "text_hash", "item_id", "start", "n")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items): items is sorted as strings, empty where nothing is hit."""
    parted = materialized(tokenised(docs), "words")
    found = materialized(occurrences(parted, benchmark, width, block), "occurrences")
    # Overlapping places are merged: each adds the words after the furthest end so far.
    place = found.select("doc_id", "text_hash", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    hit = (
        place.selectExpr(
            "doc_id",
            "text_hash",
            "start",
            "end",
            "coalesce(max(end) OVER (PARTITION BY doc_id, text_hash ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
        )
        .groupBy("doc_id", "text_hash")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit"))
    )
    items = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    sized = parted.select("doc_id", "text_hash", "n_words").distinct()
    s, h, i = sized.alias("s"), hit.alias("h"), items.alias("i")
    same = "s.doc_id <=> {0}.doc_id AND s.text_hash = {0}.text_hash"
    return (
        s.join(h, F.expr(same.format("h")), "left")
        .join(i, F.expr(same.format("i")), "left")
        .select(
            "s.doc_id",
            "s.text_hash",
            "s.n_words",
            F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("i.items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
            F.coalesce("i.items", F.array().cast("array<string>")).alias("items"),
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of `benchmark` occurs; of any id, null too."""
    found = occurrences(materialized(tokenised(docs), "words"), benchmark, width)
    bad = materialized(found.select("doc_id", "text_hash").distinct(), "contaminated")
    d = docs.select(F.struct(*docs.columns).alias("whole"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("d")
    b = bad.alias("b")
    return d.join(b, F.expr("d.whole.doc_id <=> b.doc_id AND d.text_hash = b.text_hash"), "left_anti").select("d.whole.*")

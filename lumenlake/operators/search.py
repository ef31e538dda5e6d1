"""Nearest neighbours, the adaptive relevance cut, hybrid search and similar photos.

A query vector is a literal of bounded length, so a scan keeps k rows for each task and never shuffles the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.scalar import hamming, round_even
from lumenlake.functions.vector import cosine_or_one

MOST, LEAST_RESULTS, DEFAULT_RESULTS = 2000, 10, 300
FLOOR, SCANNED, GAP = 8, 100, 0.15


def results_asked(n: int | None) -> int:
    return DEFAULT_RESULTS if n is None else max(LEAST_RESULTS, min(MOST, n))


def nearest(df: DataFrame, query: list[float], k: int, *, id_: str = "id", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """(id, distance): the k nearest rows, equal distances by id. With `digits` distances are rounded before the sort."""
    distance = cosine_or_one(F.col(vector), F.lit([float(x) for x in query]))
    distance = distance if digits is None else round_even(distance, digits)
    return df.filter(F.col(vector).isNotNull()).select(id_, distance.alias("distance")).orderBy("distance", id_).limit(k)


def relevant(found: DataFrame, strictness: int = 50, *, id_: str = "id") -> DataFrame:
    """The rows of found(id, distance) that stand out from its noise; `found` is a top-k result, at most MOST rows.

    The noise is the median and quartiles, by index, of the later half. A first jump of 15 % between neighbours among
    the first hundred is taken instead where there is one. Eight rows stay in any case."""
    if strictness == 0:
        return found
    order = Window.orderBy("distance", id_)  # over MOST rows at most
    ranked = found.select(
        "*",
        F.row_number().over(order).alias("rn"),
        F.lead("distance").over(order).alias("following"),
        F.count("*").over(Window.partitionBy()).alias("n"),
        F.sort_array(F.collect_list("distance").over(Window.partitionBy())).alias("all"),
    )
    tail = F.slice("all", (F.col("n") / 2).cast("int") + 1, F.col("n").cast("int"))
    m = F.size(tail)
    at = lambda share: F.get(tail, F.floor(m * share).cast("int"))
    k = 0.5 + (min(100, max(0, strictness)) - 25) * (1.5 / 75)
    usual = at(0.5) - k * F.greatest(at(0.75) - at(0.25), F.lit(1e-6))
    jump = (F.col("following") - F.col("distance")) / F.greatest("distance", F.lit(1e-6)) >= GAP
    cut = ranked.withColumn("usual", usual).withColumn(
        "knee", F.min(F.when(jump & (F.col("rn") <= SCANNED), F.col("distance"))).over(Window.partitionBy())
    )
    kept = cut.withColumn("within", F.col("distance") <= F.coalesce("knee", "usual")).withColumn(
        "kept", F.count_if("within").over(Window.partitionBy())
    )
    stay = (F.col("n") <= FLOOR) | F.when(F.col("kept") < FLOOR, F.col("rn") <= FLOOR).otherwise(F.col("within"))
    return kept.filter(stay).select(id_, "distance")


# The fields that are searched where none are named.
FIELDS = ("flattened_keywords", "alt_text", "caption", "title")


def matching(df: DataFrame, term: str, fields: list[str] | None = None) -> DataFrame:
    """Rows of which any field holds the term, whatever its case. Without fields all of FIELDS are searched; those that
    the rows don't have hold nothing."""
    any_of = F.lit(False)
    for f in (f for f in (fields or FIELDS) if f in df.columns):
        any_of = any_of | F.coalesce(F.contains(F.lower(f), F.lit(term.lower())), F.lit(False))
    return df.filter(any_of)


def in_scope(df: DataFrame, ids: DataFrame | None = None, catalog: Column | None = None, *, id_: str = "id") -> DataFrame:
    """Rows among the requested ids and in the catalog; either may be left out."""
    out = df if ids is None else df.join(ids.select(id_).distinct(), id_, "left_semi")
    return out if catalog is None else out.filter(catalog)


def hybrid(photos: DataFrame, query: list[float], term: str, fields: list[str], *, most: int | None = None, strictness: int = 50, id_: str = "id") -> DataFrame:
    """(id, distance, part): relevant neighbours first, then rows whose text matches, as far as the limit allows."""
    n = results_asked(most)
    semantic = relevant(nearest(photos, query, n, id_=id_, digits=4), strictness, id_=id_).withColumn("part", F.lit(0))
    text = matching(photos, term, fields).join(semantic.select(id_), id_, "left_anti").select(id_, F.lit(None).cast("double").alias("distance"), F.lit(1).alias("part"))
    both = semantic.unionByName(text.orderBy(id_).limit(n))
    return both.orderBy("part", "distance", id_).limit(n)


def similar_by_hash(photos: DataFrame, target: int, hash_: int, k: int = 10, most: int = 100, *, id_: str = "id") -> DataFrame:
    """(id, hamming): others within k bits of the hash, nearest first."""
    bits = hamming(F.col("hash"), F.lit(hash_)).cast("int")
    return photos.filter(F.col(id_) != target).select(id_, bits.alias("hamming")).filter(F.col("hamming") <= k).orderBy("hamming", id_).limit(most)


def prompt_scores(photos: DataFrame, prompts: DataFrame, *, id_: str = "id") -> DataFrame:
    """(id, score): the mean over prompt pairs (pair, good, bad) of how much nearer the good prompt is, by a logistic.

    Pairs are a handful of vectors; they're broadcast."""
    good, bad = (1 - cosine_or_one(F.col("vector"), F.col(c)) for c in ("good", "bad"))
    each = photos.join(F.broadcast(prompts), F.lit(True)).select(id_, (1 / (1 + F.exp(-100 * (good - bad)))).alias("score"))
    return each.groupBy(id_).agg(F.avg("score").alias("score"))

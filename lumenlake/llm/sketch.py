"""Document fingerprints: threshold-scaled sketches of word shingles, with Spark expressions only.

A sketch keeps every 48-bit shingle hash below a fixed fraction of the hash range. Sketches of unequal documents are
comparable, and the union of sketches is the sketch of the union. Short documents would keep too little, so the `FLOOR`
smallest hashes are kept in any case; a union is cut by the same rule. Estimates then use the range that both sketches
cover: up to the fraction, or up to the largest hash where only the floor was kept.

A fingerprint is text: the number of distinct shingles, then the hashes in 12 hex digits each, ascending.

Defined cases: a null text is an empty one, whose sketch is empty; a text of fewer than `SHINGLE` words is one shingle;
two empty sketches have likeness 1, an empty and another 0; rows with equal ids are ordered by their texts, nulls last;
rows that repeat are all kept; a table of one row is followed by itself; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import tokens

SHINGLE = 5
FRACTION = 1 / 8
FLOOR = 16
BITS = 48
LIMIT = int(FRACTION * 2**BITS)
#: Characters of text in a range of ids, on average; each range is sorted by one task, which may spill.
RANGE = 1 << 27
#: Ranges whose first rows are broadcast at most; more are joined by a shuffle.
FEW = 100_000


def kept(hashes: Column) -> Column:
    """The hashes that a sketch keeps of distinct ones."""
    below = F.filter(hashes, lambda h: h < LIMIT)
    return F.when(F.size(below) >= FLOOR, F.array_sort(below)).otherwise(F.slice(F.array_sort(hashes), 1, FLOOR))


def sketched(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the column `out`: struct<n, hashes> of the column `text`."""
    words = df.withColumn("__words", tokens(F.col(text)))
    n = F.size("__words")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))))
    shingle = lambda i: F.concat_ws(" ", *(F.get("__words", i + j) for j in range(SHINGLE)))
    hashed = words.withColumn(
        "__hashes", F.array_distinct(F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(shingle(i)), 64 - BITS)))
    )
    return hashed.withColumn(out, F.struct(F.size("__hashes").alias("n"), kept(F.col("__hashes")).alias("hashes"))).drop("__words", "__hashes")


def fingerprint(sketch: Column) -> Column:
    digits = F.transform(sketch["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0"))
    return F.concat(sketch["n"].cast("string"), F.lit(":"), F.array_join(digits, ""))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles; its n is a lower bound."""
    hashes = F.array_union(a["hashes"], b["hashes"])
    return F.struct(F.greatest(a["n"], b["n"], F.size(hashes)).alias("n"), kept(hashes).alias("hashes"))


def _reach(sketch: Column) -> Column:
    """Up to which hash the sketch holds all: everything, the fraction, or the floor's largest."""
    return (
        F.when(F.size(sketch["hashes"]) == sketch["n"], F.lit(2**BITS))
        .when(F.element_at(sketch["hashes"], -1) >= LIMIT, F.element_at(sketch["hashes"], -1))
        .otherwise(F.lit(LIMIT - 1))
    )


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    reach = F.least(_reach(a), _reach(b))
    x, y = (F.filter(s["hashes"], lambda h: h <= reach) for s in (a, b))
    return x, y, F.size(F.array_intersect(x, y))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two sketches."""
    x, y, both = _common(a, b)
    either = F.size(x) + F.size(y) - both
    return F.when(either == 0, F.when(a["n"] == b["n"], 1.0).otherwise(0.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has."""
    x, _, both = _common(a, b)
    return F.when(F.size(x) == 0, F.when(a["n"] == 0, 1.0).otherwise(0.0)).otherwise(both / F.size(x))


def ranges_of(docs: DataFrame, size: int) -> list[int]:
    """Ids that cut docs(doc_id, text) into ranges of about equally many rows and `size` characters: each range's largest."""
    chars, n = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, min(n, -(-chars // size)))
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", F.lit(shares), max(10_000, 4 * parts)).alias("at")).first().at if shares else []
    return sorted(set(found or []))


def range_of(doc_id: Column, ends: list[int]) -> Column:
    """The number of the range of an id, ascending as ids descend: first among blocks of ends, then within one.

    Ids above the last end are range 0; a null id comes after all."""
    step = max(1, math.isqrt(len(ends)))
    cut = [ends[i : i + step] for i in range(0, len(ends), step)]
    if not cut:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    whole = F.size(F.filter(F.lit([c[-1] for c in cut]), lambda e: e < doc_id))
    inside = F.size(F.filter(F.coalesce(F.get(F.lit(cut), whole), F.array().cast("array<bigint>")), lambda e: e < doc_id))
    below = F.when(whole == len(cut), len(ends)).otherwise(whole * step + inside)
    return F.when(doc_id.isNull(), len(ends) + 1).otherwise(len(ends) - below)


def with_next(docs: DataFrame, columns: list[str], size: int = RANGE, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`docs` with next_<column>: that of the following row by descending doc_id, after the last that of the first.

    Ids are cut into ranges by their quantiles, each sorted on its own; each range also gets a copy of the first row of
    the range below it, so that no task sorts all rows. Ids are integers; rows of one id stay in one range. `prepare`
    adds columns to rows before they are sorted."""
    ends = ranges_of(docs, size)
    placed = docs.withColumn("__range", range_of(F.col("doc_id"), ends)).withColumn("__order", F.xxhash64(F.coalesce("text", F.lit(""))))
    light = placed.groupBy("__range").agg(F.max("doc_id").alias("__head"))
    # Every range but the first and that of nulls holds an end; those that hold none may be empty.
    held = sorted(r["__range"] for r in light.filter(F.col("__range").isin(0, 1, len(ends), len(ends) + 1)).select("__range").collect())
    if not held:
        return (prepare(docs) if prepare else docs).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    low, high = held[0], held[-1]
    heads = light.select(F.when(F.col("__range") == low, high).otherwise(F.col("__range") - 1).alias("__to"), F.col("__range").alias("__from"), "__head")
    heads = (F.broadcast(heads) if len(ends) <= FEW else heads).alias("h")
    rows = placed.select("doc_id", "text", "__range", "__order", *[c for c in columns if c in docs.columns and c not in ("doc_id", "text")])
    found = rows.alias("r").join(heads, F.expr("r.__range = h.__from AND r.doc_id <=> h.__head"))
    first_of = found.selectExpr("h.__to", "r.*", "row_number() OVER (PARTITION BY r.__range ORDER BY r.__order, r.text) AS __n").filter("__n = 1")
    extra = first_of.withColumn("__range", F.col("__to")).drop("__to", "__n").withColumn("__extra", F.lit(True))
    both = placed.withColumn("__extra", F.lit(False)).unionByName(extra, allowMissingColumns=True)
    if prepare:
        both = prepare(both)
    order = [F.col("doc_id").desc_nulls_last(), F.col("__order"), F.col("text")]
    w = Window.partitionBy("__range").orderBy(F.col("__extra"), *order)
    return (
        both.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
        .filter(~F.col("__extra"))
        .drop("__range", "__order", "__extra")
    )


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Every row of docs(doc_id, text) with the sketches of its text, its edited text and the next row's text.

    The edit replaces the last half (rounded down) of the characters by the first as many of the next text."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    following = with_next(own, ["text", "sketch"], prepare=lambda rows: sketched(rows, "text", "sketch"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.substring(F.col("next_text"), F.lit(1), half))
    changed = following.select("doc_id", "sketch", "next_sketch", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    return sketched(changed, "edited", "edited_sketch")

"""Keywords: case-insensitive duplicates, merges, and ranked vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(rows: DataFrame, by: str, word: str, position: str) -> DataFrame:
    """The first spelling of each word in each list, in its place."""
    first = Window.partitionBy(by, F.lower(F.trim(word))).orderBy(position)
    return rows.select("*", F.row_number().over(first).alias("__n")).filter("__n = 1").drop("__n")


def merged(rows: DataFrame, by: str, word: str, position: str, mapping: dict[str, str]) -> DataFrame:
    """(by, keywords): each list's words in their order, those of the mapping (by lower case) replaced, each spelling once."""
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    renamed = rows.withColumn(word, F.coalesce(F.try_element_at(names, F.lower(word)), F.col(word)))
    listed = F.array_sort(F.collect_list(F.struct(position, word)))
    return deduplicated(renamed, by, word, position).groupBy(by).agg(listed.alias("k")).select(by, F.col(f"k.{word}").alias("keywords"))


def vocabulary(uses: DataFrame, pinned: list[str], most: int, position: str = "position") -> DataFrame:
    """(name, uses) in alphabetical order: pinned words, then the most used of uses(name, uses, position), `most` in all.

    Pinned words count whether anybody uses them or not, and never go beyond `most`. Spellings that differ in case are one
    word, shown as it is pinned or else as it first stands; words used equally often come by that name. Counts fold
    spellings in partial aggregates, so a word that a third of all rows use is one row for each task."""
    fixed: dict[str, str] = {}
    for p in filter(None, map(str.strip, pinned)):
        if len(fixed) < most:
            fixed.setdefault(p.lower(), p)
    named = uses.select(F.trim("name").alias("name"), "uses", position).filter("name <> ''")
    folded = named.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct(position, "name")).alias("name"), F.sum(F.coalesce("uses", F.lit(0))).alias("uses"))
    first = uses.sparkSession.createDataFrame(list(fixed.items()), "key string, pinned string")
    rest = folded.join(first, "key", "left_anti").orderBy(F.desc("uses"), "name").limit(most - len(fixed)).select("name", "uses")
    kept = F.broadcast(first).join(folded, "key", "left").select(F.col("pinned").alias("name"), F.coalesce("uses", F.lit(0)).alias("uses"))
    return kept.unionByName(rest).orderBy("name")


def siblings(tree: DataFrame) -> DataFrame:
    """(parent, leaves): parents of two leaves and more in tree(name, parent)."""
    inner = tree.select(F.col("parent").alias("name")).distinct()
    leaves = tree.join(inner, "name", "left_anti")
    return leaves.groupBy("parent").agg(F.array_sort(F.collect_set("name")).alias("leaves")).filter(F.size("leaves") >= 2)


def condensed(messages: Column, most: int = 5) -> Column:
    """The first few different messages of an array, in their order, joined by bars."""
    return F.array_join(F.slice(F.array_distinct(messages), 1, most), " | ")


def summaries(rows: DataFrame, by: str, message: str, position: str, shown: int = 5) -> DataFrame:
    """(by, messages): each list's different messages as they first come, a line each; those beyond `shown` are counted.

    Null messages are none; repeats meet in partial aggregates before the shuffle, and no list is collected beyond `shown`."""
    once = rows.filter(F.col(message).isNotNull()).groupBy(by, message).agg(F.min(position).alias("at"))
    numbered = once.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("at", message)))
    lines = F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", message))))
    listed = numbered.groupBy(by).agg(F.transform(lines, lambda x: x[message]).alias("lines"), F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("...and "), (F.col("n") - shown).cast("string"), F.lit(" more")))
    return listed.select(by, F.concat_ws("\n", "lines", more).alias("messages"))

"""Groups of words that a language model is asked to confirm: chunks to ask about, and what its replies confirm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.parsing import reply_groups

#: Groups in a question. Fixed value.
CHUNK = 15


def chunked(candidates: DataFrame, size: int = CHUNK) -> DataFrame:
    """(list, chunk, groups) of candidates(list, position, members): `size` groups a chunk, in order.

    Positions start at 0 and have no gaps; a chunk is bounded by its size."""
    chunk = F.floor(F.col("position") / size).cast("int")
    row = F.struct("position", "members")
    found = candidates.groupBy("list", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return found.select("list", "chunk", F.col("rows.members").alias("groups"))


def validated(candidates: DataFrame, replies: DataFrame, size: int = CHUNK) -> DataFrame:
    """(list, chunk, n, members, confirmed): groups that replies(list, chunk, reply) confirm, numbered within the chunk.

    A chunk without a reply, or with one that holds no sound list, keeps its candidates of two words and more as they are,
    unconfirmed."""
    asked = chunked(candidates, size).join(replies.select("list", "chunk", "reply"), ["list", "chunk"], "left")
    said = reply_groups(F.col("reply"), F.size("groups"))
    told = asked.withColumn("said", said).withColumn("kept", F.coalesce("said", F.filter("groups", lambda g: F.size(g) >= 2)))
    return told.select("list", "chunk", F.col("said").isNotNull().alias("confirmed"), F.posexplode("kept").alias("n", "members"))

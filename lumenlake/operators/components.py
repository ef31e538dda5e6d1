"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.plans.lineage import materialized

#: A key of more rows than this share of all is hot; so there are a thousand at most.
HOT = 1 / 1000


def joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` left-joined with table(key, ...), which has a row for each key at most. Rows of hot keys stay where they
    are and get what the table has for them by broadcast; all others are shuffled."""
    crowded = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > rows.count() * HOT).select(key))
    few = F.broadcast(table.join(crowded, key, "left_semi"))
    hot = rows.join(crowded, key, "left_semi").join(few, key, "left")
    return hot.unionByName(rows.join(crowded, key, "left_anti").join(table, key, "left"))


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step on n edges(a, b) with a > b: every edge then points at a smaller node."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"), "n")
    # Hubs' smallest neighbours are broadcast to their edges, which stay where they are.
    hubs = F.broadcast(low.filter(F.col("n") > 2 * n * HOT))
    most = both.join(hubs, both.a == hubs.c, "left_anti").join(low, F.col("a") == F.col("c"))
    met = most.select("a", "b", "m").union(both.join(hubs, both.a == hubs.c).select("a", "b", "m"))
    # Large star: each larger neighbour of a node is tied to the smallest of the node and its neighbours.
    large = met.filter("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # Small star: a node's smaller neighbours, and the node, are tied to the smallest of them.
    least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
    small = large.join(least, large.a == least.c).select(
        F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
    )
    return small.select("e.a", "e.b").filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the smallest node that it reaches.

    Self loops are ignored. Each round is written to the shared folder, so the plan doesn't grow and no executor's loss
    costs more than a round. Raises if `rounds` don't suffice."""
    now = materialized(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components"
    )
    before = None
    for _ in range(rounds):
        # Done when every node has one edge and no root has one: a sum over the edges that repeats says so.
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before, now = mark, materialized(_stars(now, mark[0]), "components")
    raise RuntimeError(f"no components after {rounds} rounds")

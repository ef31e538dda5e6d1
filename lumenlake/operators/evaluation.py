"""Evaluation of groupings and rankings against labels; a share of nothing is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def pair_agreement(rows: DataFrame, label: str, group: str) -> DataFrame:
    """One row: pairs with equal labels, in equal groups, in both, precision and recall.

    Pairs are counted from sizes of cells, never made."""
    pairs = lambda n: F.sum(n * (n - 1) / 2).cast("long")
    cells = rows.groupBy(label, group).agg(F.count("*").alias("n"))
    n = F.col("n")
    both = cells.agg(pairs(n).alias("both"))
    labelled = cells.groupBy(label).agg(F.sum("n").alias("n")).agg(pairs(n).alias("labelled"))
    predicted = cells.groupBy(group).agg(F.sum("n").alias("n")).agg(pairs(n).alias("predicted"))
    out = both.join(labelled, F.lit(True)).join(predicted, F.lit(True))  # a row each
    b = F.col("both")
    return out.select("labelled", "predicted", "both", share(b, F.col("predicted")).alias("precision"), share(b, F.col("labelled")).alias("recall"))


def ndcg(rows: DataFrame, group: str, rank: str, gain: str) -> DataFrame:
    """(group, ndcg): gains discounted by log2(rank + 1), over those of the best order."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(gain), F.asc(rank)))
    each = rows.select(group, (F.col(gain) / F.log2(F.col(rank) + 1)).alias("got"), (F.col(gain) / F.log2(best + 1)).alias("ideal"))
    return each.groupBy(group).agg(share(F.sum("got"), F.sum("ideal")).alias("ndcg"))


def winners(rows: DataFrame, group: str, predicted_rank: str, label_rank: str, predicted_reject: str, label_reject: str) -> DataFrame:
    """One row: how often the best is found, and precision and recall of rejects."""
    hit = rows.filter(F.col(predicted_rank) == 1).agg(F.count("*").alias("groups"), F.count_if(F.col(label_rank) == 1).alias("hits"))
    r = rows.agg(
        F.count_if(F.col(predicted_reject)).alias("rejects"), F.count_if(F.col(label_reject)).alias("labelled_rejects"), F.count_if(F.col(predicted_reject) & F.col(label_reject)).alias("both")
    )
    return hit.join(r, F.lit(True)).select(
        "groups", share(F.col("hits"), F.col("groups")).alias("top1"), share(F.col("both"), F.col("rejects")).alias("reject_precision"), share(F.col("both"), F.col("labelled_rejects")).alias("reject_recall")
    )


def label_ranks(rows: DataFrame, group: str, pick: str, rating: str, *position: str) -> DataFrame:
    """`rows` with rank and reject: within a group picked frames (1) come first, then higher ratings, ties as they stand.

    Missing marks count as none. A group in which nothing is marked has no ranks and no rejects; a pick of -1 rejects.
    Rows that tie in `position` too are ranked in no set order, so it must tell a group's rows apart."""
    p, stars = F.coalesce(pick, F.lit(0)), F.coalesce(rating, F.lit(0))
    marked = F.max((p != 0) | (stars > 0)).over(Window.partitionBy(group))
    at = F.row_number().over(Window.partitionBy(group).orderBy((p == 1).desc(), stars.desc(), *position))
    return rows.withColumns({"rank": F.when(marked, at), "reject": marked & (p == -1)})

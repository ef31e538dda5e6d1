"""Reports on fixtures: how well produced groups, ranks and rejects agree with labels, and reports of a whole corpus.

A report holds counts and one sum, which add up over fixtures; shares are taken last, so a fixture of three groups doesn't
weigh as much as one of three hundred."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.evaluation import share
from lumenlake.plans.lineage import materialized

COUNTS = (
    "ranked_groups", "winner_hits", "rejects_predicted", "rejects_labelled", "rejects_correct", "sets_labelled", "sets_preserved", "sets_recognised",
    "pairs_predicted", "pairs_labelled", "pairs_correct",
)


def _pairs(cells: DataFrame, by: list[str], name: str) -> DataFrame:
    """(fixture, name): pairs within cells, counted from their sizes."""
    n = F.col("n")
    return cells.groupBy("fixture", *by).agg(F.sum("n").alias("n")).groupBy("fixture").agg(F.sum(n * (n - 1) / 2).cast("long").alias(name))


def reports(labels: DataFrame, produced: DataFrame) -> DataFrame:
    """(fixture, *COUNTS, ndcg_sum) of labels(fixture, authoritative, group_id, intentional_set, at, photo_id, rank, reject)
    and produced(fixture, photo_id, group, score, reject, keep_all).

    Ranks are judged within labelled groups of two and more that name a best frame: by score, then by id; a frame that
    wasn't produced scores 0. Frames of an intentional set have no ranks and no rejects: the set is preserved if all are
    produced and none is rejected, and recognised if they are one produced group, no more and no less, that keeps all.
    Pairs are only counted where groups are a human judgement."""
    p = produced.select(F.col("fixture").alias("f"), F.col("photo_id").alias("p"), "group", "score", F.col("reject").alias("rejected"), "keep_all")
    p = p.withColumn("produced_size", F.count("*").over(Window.partitionBy("f", "group")))
    met = materialized(labels.join(p, (F.col("fixture") == F.col("f")) & (F.col("photo_id") == F.col("p")), "left").drop("f"), "labelled")
    size = F.count("*").over(Window.partitionBy("fixture", "group_id"))
    gain = F.when(F.col("rank").between(1, F.col("size")), F.col("size") + 1 - F.col("rank")).otherwise(0)
    plain = met.filter("intentional_set IS NULL").withColumn("size", size).withColumn("gain", gain)
    by_score = Window.partitionBy("fixture", "group_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "photo_id")
    by_gain = Window.partitionBy("fixture", "group_id").orderBy(F.desc("gain"))
    placed = plain.withColumn("place", F.row_number().over(by_score)).withColumn("best", F.row_number().over(by_gain))
    groups = placed.groupBy("fixture", "group_id").agg(
        F.max("size").alias("size"),
        F.coalesce(F.max(F.col("rank") == 1), F.lit(False)).alias("has_best"),
        F.coalesce(F.max((F.col("place") == 1) & (F.col("rank") == 1)), F.lit(False)).alias("hit"),
        share(F.sum(F.col("gain") / F.log2(F.col("place") + 1)), F.sum(F.col("gain") / F.log2(F.col("best") + 1))).alias("ndcg"),
        F.count_if("reject").alias("rejects"),
    )
    counts = (F.col("size") > 1) & F.col("has_best")
    ranked = groups.groupBy("fixture").agg(
        F.count_if(counts).alias("ranked_groups"), F.count_if(counts & F.col("hit")).alias("winner_hits"), F.coalesce(F.sum(F.when(counts, F.col("ndcg"))), F.lit(0.0)).alias("ndcg_sum"), F.sum("rejects").alias("rejects_labelled")
    )
    sets = met.filter("intentional_set IS NOT NULL").groupBy("fixture", "group_id").agg(
        F.count("*").alias("size"),
        F.min(F.coalesce(~F.col("rejected"), F.lit(False))).alias("preserved"),
        F.count_distinct("group").alias("groups"),
        F.max(F.when(F.col("at") == 0, F.struct("keep_all", "produced_size"))).alias("first"),
    )
    recognised = F.coalesce((F.col("groups") == 1) & F.col("first.keep_all") & (F.col("first.produced_size") == F.col("size")), F.lit(False))
    kept = sets.groupBy("fixture").agg(F.count("*").alias("sets_labelled"), F.count_if("preserved").alias("sets_preserved"), F.count_if(recognised).alias("sets_recognised"))
    right = labels.groupBy(F.col("fixture").alias("f"), F.col("photo_id").alias("p")).agg(F.max("reject").alias("right"))
    rejects = produced.filter("reject").join(right, (F.col("fixture") == F.col("f")) & (F.col("photo_id") == F.col("p")), "left").groupBy("fixture").agg(
        F.count("*").alias("rejects_predicted"), F.count_if(F.coalesce("right", F.lit(False))).alias("rejects_correct")
    )
    judged = labels.filter("authoritative").select("fixture").distinct()
    own = labels.filter("authoritative").groupBy("fixture", "group_id").agg(F.count_distinct("photo_id").alias("n"))
    made = produced.join(judged, "fixture", "left_semi").groupBy("fixture", "group").agg(F.count("*").alias("n"))
    both = met.filter("authoritative AND group IS NOT NULL").groupBy("fixture", "group_id", "group").agg(F.count_distinct("photo_id").alias("n"))
    out = labels.select("fixture").distinct()
    for part in (ranked, kept, rejects, _pairs(made, ["group"], "pairs_predicted"), _pairs(own, ["group_id"], "pairs_labelled"), _pairs(both, ["group_id", "group"], "pairs_correct")):
        out = out.join(part, "fixture", "left")
    return out.select("fixture", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("ndcg_sum", F.lit(0.0)).alias("ndcg_sum"))


def corpus(each: DataFrame, name: str) -> DataFrame:
    """One report for all fixtures."""
    total = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), F.coalesce(F.sum("ndcg_sum"), F.lit(0.0)).alias("ndcg_sum"))
    return total.select(F.lit(name).alias("fixture"), *COUNTS, "ndcg_sum")


def measured(each: DataFrame) -> DataFrame:
    """Reports with shares, 0 of nothing."""
    col = F.col
    return each.select(
        "fixture",
        *COUNTS,
        share(col("winner_hits"), col("ranked_groups")).alias("winner_accuracy"),
        share(col("ndcg_sum"), col("ranked_groups")).alias("ndcg"),
        share(col("rejects_correct"), col("rejects_predicted")).alias("reject_precision"),
        share(col("rejects_correct"), col("rejects_labelled")).alias("reject_recall"),
        share(col("sets_preserved"), col("sets_labelled")).alias("set_preservation"),
        share(col("sets_recognised"), col("sets_labelled")).alias("set_recognition"),
        share(col("pairs_correct"), col("pairs_predicted")).alias("grouping_precision"),
        share(col("pairs_correct"), col("pairs_labelled")).alias("grouping_recall"),
    )

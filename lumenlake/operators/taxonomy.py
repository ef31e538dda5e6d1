"""Taxonomy: probabilities of species rolled up to their ranks, and pruning of taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.parsing import epithet, usable_genus


def probabilities(rows: DataFrame, by: list[str], logit: str) -> DataFrame:
    """`rows` with p, the softmax of logits within `by`; the largest is taken off first."""
    peak = rows.groupBy(*by).agg(F.max(logit).alias("peak")) if by else rows.agg(F.max(logit).alias("peak"))
    lifted = (rows.join(peak, by) if by else rows.join(F.broadcast(peak), F.lit(True))).withColumn("w", F.exp(F.col(logit) - F.col("peak")))
    total = lifted.groupBy(*by).agg(F.sum("w").alias("total")) if by else lifted.agg(F.sum("w").alias("total"))
    out = lifted.join(total, by) if by else lifted.join(F.broadcast(total), F.lit(True))
    return out.withColumn("p", F.col("w") / F.col("total")).drop("w", "peak", "total")


def rolled_up(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """(depth, *ranks, p): sums of p over all prefixes of the path, ranks beyond the depth null."""
    n = len(ranks)
    summed = rows.rollup(*ranks).agg(F.sum("p").alias("p"), F.grouping_id().alias("g"))
    depth = F.lit(n) - F.bit_count("g").cast("int")
    return summed.select(depth.alias("depth"), *ranks, "p").filter("depth > 0")


def answer(rolled: DataFrame, ranks: list[str], floor: float) -> DataFrame:
    """The best node of the deepest rank on which one reaches the floor and has a name; of equal ones the first by path."""
    best = rolled.groupBy("depth").agg(F.min_by(F.struct(*ranks, "p"), F.struct((-F.col("p")).alias("order"), *ranks)).alias("best"))
    name = F.array(*(F.col(f"best.{r}") for r in ranks))
    return best.filter((F.col("best.p") >= floor) & (F.coalesce(F.get(name, F.col("depth") - 1), F.lit("")) != "")).orderBy(F.desc("depth")).limit(1).select("depth", "best.*")


def pruned(taxa: DataFrame, classes: list[str]) -> DataFrame:
    """taxa(id, class, genus, name) of listed classes with a common name, and one of each genus left out."""
    kept = taxa.filter(F.col("class").isin(classes) & (F.coalesce("name", F.lit("")) != ""))
    others = taxa.join(kept.select("genus").distinct(), "genus", "left_anti")
    first = Window.partitionBy("genus").orderBy("id")
    one = others.select("*", F.row_number().over(first).alias("__n")).filter("__n = 1").drop("__n")
    return kept.unionByName(one)


#: The score below which a photo shows no living thing. Fixed value.
ORGANISM = 0.35


def worth_asking(score: Column, gate: bool = True, least: float = ORGANISM) -> Column:
    """Whether species are looked for: without a gate or a score they are. A photo held back still counts as checked."""
    return F.lit(not gate) | F.coalesce(score >= least, F.lit(True))


def cleaned(taxa: DataFrame) -> DataFrame:
    """taxa(genus, species, ...) that name a species: the genus is one capitalised word and the species holds an epithet, which
    stands alone afterwards."""
    return taxa.withColumn("species", epithet(F.col("species"))).filter(usable_genus(F.col("genus")) & F.col("species").isNotNull())

"""Positions in one order over all rows, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.plans.lineage import materialized

#: Rows of a slice, and slices at most; a slice is sorted by one task, which may spill.
PER_SLICE, SLICES = 1 << 18, 4096


def positions(rows: DataFrame, order: list[Column], name: str, per_slice: int = PER_SLICE) -> DataFrame:
    """`rows` with a column `name`: 1, 2, 3 ... in `order`.

    Rows are dealt to slices by ranges of the order, sorted there and written with their place in the slice; what stands
    before each slice is a sum over at most SLICES counts. Rows that tie in `order` get different positions in no set
    order, and all go to one slice: callers give a total order."""
    held = materialized(rows, "unordered")  # ranges are cut from a sample, which must be of the same rows
    slices = min(SLICES, held.count() // per_slice + 1)
    dealt = held.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    placed = materialized(dealt.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "ordered")
    # The id holds the slice in its upper bits and the place in the slice in its lower 33.
    sizes = dict(placed.groupBy(F.shiftright("id", 33).cast("int").alias("slice")).count().collect())
    before, total = [], 0
    for i in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    slice_of, place = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND((1 << 33) - 1)
    at = F.element_at(F.lit(before).cast("array<long>"), slice_of + 1) + place + 1
    return placed.select("row.*", at.alias(name))

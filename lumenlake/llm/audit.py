"""An audit of how filters interact: what each of them removes at each place of every order.

Five filters are judged once for each document, as a mask of five bits. Which filter of an order removes a document
depends on the mask only, so a table of 32 masks by 120 orders, computed beforehand, gives the step of the first failure.
Tasks look their documents up in it and count steps by part, order and label; the counts, of a fixed length for each
part, are summed. All figures follow from them: nobody runs a filter 120 times.

Filters: A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * letters A-Z > 10 * code points; D: holds one of
`#$%&*|`; E: identical to the text of a smaller doc_id, removed or not. Words are runs of characters other than ASCII white
space, case-sensitive.

Defined cases: a null text is an empty one, which fails A and, where a smaller id has an empty text too, E; a null lang is
the part ''; a null id is neither smaller nor larger than any other, so its row never fails E; rows that repeat are counted
each, and none of equal ids is a copy of the other; of repeated labels of one id, one that says 1 is enough, and labels
without an id are ignored; texts of any length are judged whole, within one task; extra columns are ignored, whatever their
names. Without documents there are no parts and no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import materialized
from lumenlake.llm.components import joined

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
STEPS = len(FILTERS) + 1  # the last: kept to the end
_CELLS = len(ORDERS) * STEPS
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = re.compile(rb"[#$%&*|]")
#: Rows looked up at once, and parts whose counts a task holds at once.
_ROWS, _PARTS = 4096, 1000


def first_failures() -> np.ndarray:
    """By mask and order: the step, from 0, of the first filter that the mask fails; STEPS - 1 if it fails none."""
    masks = np.arange(1 << len(FILTERS))
    places = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    fails = masks[:, None, None] >> places[None] & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS - 1)


def text_mask(text: bytes) -> int:
    """The bits of filters A to D that a text fails; A is the lowest."""
    words = text.split()  # bytes: ASCII white space only
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * points, bool(_MARKS.search(text)))
    return sum(bit << i for i, bit in enumerate(fails))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for every row of docs(doc_id, lang, text)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for t in batch.column("text"):
                text = t.as_py() or b""
                found.append(text_mask(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(found, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    judged = materialized(asked.mapInArrow(judge, f"doc_id {kind}, part string, mask int, digest binary"), "audit-masks")
    # Copies meet in partial aggregates before the shuffle; texts of which there is one only aren't joined to anything.
    copies = materialized(judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "audit-copies")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined(judged, copies, "digest").select("doc_id", "part", (F.col("mask") + F.when(late, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def step_counts(judged: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic) of judged(part, mask, good, toxic): documents by order and step of their first
    failure, cell = order * STEPS + step. Every part has all cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = first_failures() + np.arange(len(ORDERS)) * STEPS
        held: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            columns = [pa.array([list(v[i]) for v in held.values()], pa.list_(pa.int64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *columns], ["part", "n", "good", "toxic"])

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                parts = rows.column("part").dictionary_encode()
                cells = (first[rows.column("mask").to_numpy()] + parts.indices.to_numpy()[:, None] * _CELLS).ravel()
                size = len(parts.dictionary) * _CELLS
                found = [np.bincount(cells, minlength=size)]
                for label in ("good", "toxic"):
                    own = rows.column(label).to_numpy(zero_copy_only=False)
                    found.append(np.bincount(cells, np.repeat(own, len(ORDERS)), size).astype(np.int64))
                for part, counts in zip(parts.dictionary.to_pylist(), np.stack(found).reshape(3, -1, _CELLS).swapaxes(0, 1), strict=True):
                    held[part] = held[part] + counts if part in held else counts
                if len(held) >= _PARTS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    partial = judged.select("part", "mask", "good", "toxic").mapInArrow(count, "part string, n array<long>, good array<long>, toxic array<long>")
    each = partial.select("part", F.posexplode(F.arrays_zip("n", "good", "toxic")).alias("cell", "c"))
    return each.groupBy("part", "cell").agg(*(F.sum(f"c.{x}").alias(x) for x in ("n", "good", "toxic")))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) of docs(doc_id, lang, text) with labels(doc_id, quality, toxic).

    Of a filter: what fails it is removed where it comes first; what fails nothing else is removed where it comes last."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    judged = masks(docs).join(said, "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    counts = materialized(step_counts(judged), "audit-counts")  # 720 rows for each part
    order, step = F.element_at(F.lit(ORDERS), F.floor(F.col("cell") / STEPS).cast("int") + 1), (F.col("cell") % STEPS + 1).cast("int")
    placed = counts.select("part", order.alias("filter_order"), step.alias("step"), "n", "good", "toxic")
    later = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    of = Window.partitionBy("part", "filter")
    return (
        placed.select("*", F.sum("n").over(later).alias("kept"))
        .filter(F.col("step") < STEPS)
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .select(
            "part",
            "filter_order",
            "step",
            "kept",
            F.col("n").alias("removed"),
            (F.max(F.when(F.col("step") == 1, F.col("n"))).over(of) - F.col("n")).alias("redundant"),
            F.max(F.when(F.col("step") == STEPS - 1, F.col("n"))).over(of).alias("unique_fails"),
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            F.sum("n").over(of).alias("shapley"),
        )
    )

"""The corpus pipeline: toxicity, near copies, benchmark passages, then encoding.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last
return the columns of `documents`. Between stages documents are written as Parquet and read again, so a lost executor
costs no more than the stage it was in.

Near copies are op5's: fingerprints of 3-word shingles that differ in 3 bits or fewer, and what these links connect.

Defined cases, for all stages: a null text is an empty one, which is neither toxic nor contaminated; empty texts, and
texts of the same words, are copies of each other; of equal or near copies the smallest doc_id stays, ids that are null
last, then the smallest hash of the text; rows that repeat one document are reduced to one by near copies; different texts
under one id are judged on their own; columns beyond those of `documents` are carried through, whatever their names; empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import decontaminate, pieces, simhash, toxicity
from lumenlake.llm.common import materialized, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays, as op5 finds them."""
    return simhash.one_of_each_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item stands go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's best segmentation into pieces, checked by decoding."""
    return pieces.round_trips(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can express neither the trained model nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

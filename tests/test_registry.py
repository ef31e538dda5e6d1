"""Registries as streams, in one batch and in many: results follow from event times only."""

import itertools

import pytest
from pyspark.sql import functions as F

from lumenlake.streaming import ingest, registry

NEWS = [
    ("a", 0, "create", None, None), ("a", 100, "progress", 0.5, None), ("a", 600, "poll", None, None), ("a", 1200, "poll", None, None), ("a", 1300, "done", 7.0, None), ("a", 1301, "poll", None, None), ("a", 1302, "poll", None, None),
    ("b", 0, "create", None, None), ("b", 600, "error", None, "broken"), ("b", 700, "done", 1.0, None), ("b", 700, "poll", None, None),
    ("c", 5, "create", None, None), ("c", 606, "poll", None, None), ("c", 700, "progress", 1.0, None), ("d", 9, "poll", None, None), ("d", 10, "done", 1.0, None),
    ("e", 50, "create", None, None), ("e", 60, "strange", 3.0, None), ("e", 70, "progress", 2.0, None), (None, 80, "create", None, None), ("f", 1900, "create", None, None), ("g", 2500, "create", None, None),
]
TOLD = {
    ("a", 600000, "running", None, None, 0.5), ("a", 1200000, "running", None, None, 0.5), ("a", 1301000, "done", 7.0, None, 0.5), ("a", 1302000, "missing", None, None, None),
    ("b", 700000, "done", 1.0, "broken", None), ("c", 605001, "expired", None, None, None), ("c", 606000, "missing", None, None, None), ("d", 9000, "missing", None, None, None), ("e", 670001, "expired", None, None, 2.0),
}

LOOKUPS = [
    ("x", 0, True), ("x", 99, False), ("x", 100, None), ("x", 101, False), ("x", 110, True), ("x", 111, True), ("y", 0, None), ("y", 1, False), ("y", 5, True), ("y", 11, None), ("y", 400, True), (None, 3, True), ("z", 500, False),
]
ANSWERS = {
    ("x", 0, "fetched", True, 0), ("x", 99, "hit", True, 0), ("x", 100, "failed", None, None), ("x", 101, "fetched", False, 101), ("x", 110, "remembered_miss", False, 101), ("x", 111, "fetched", True, 111),
    ("y", 0, "failed", None, None), ("y", 1, "fetched", False, 1), ("y", 5, "remembered_miss", False, 1), ("y", 11, "failed", None, None), ("y", 400, "fetched", True, 400), ("z", 500, "fetched", False, 500),
}

#: Spark takes the very first second for late.
ZERO = 10000


def streamed(spark, folder, rows, schema, build, files):
    """The rows in order of time, in `files` micro-batches."""
    rows = sorted(((*r[:1], r[1], i, *r[2:]) for i, r in enumerate(rows)), key=lambda r: r[1:3])
    size = -(-len(rows) // files)
    for i, part in enumerate(itertools.batched(rows, size)):
        told = spark.createDataFrame(list(part), schema).withColumn("ts", F.timestamp_seconds(F.col("s") + ZERO)).drop("s").coalesce(1)
        told.write.mode("append").parquet(f"{folder}/in")
        schema_ = told.schema
    source = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = build(source)
    ingest.run_once(found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), f"{folder}/state", registry.CONFIG)
    return spark.read.schema(found.schema).parquet(f"{folder}/out").collect()


@pytest.mark.parametrize("files", [1, 4])
def test_jobs(spark, tmp_path, files):
    found = streamed(spark, tmp_path, NEWS, "job string, s long, position long, kind string, number double, text string", lambda s: registry.polled_jobs(s, "10 seconds"), files)
    rows = [(r.job, r.at - ZERO * 1000, r.status, r.result, r.error, r.progress) for r in found]
    assert len(rows) == len(set(rows)) and set(rows) == TOLD
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != registry.CONFIG["spark.sql.streaming.stateStore.providerClass"]


@pytest.mark.parametrize("files", [1, 4])
def test_remembered(spark, tmp_path, files):
    found = streamed(spark, tmp_path, LOOKUPS, "key string, s long, position long, answer boolean", lambda s: registry.remembered(s, "10 seconds", resolved=100, unresolved=10), files)
    rows = [(r.key, r.at // 1000 - ZERO, r.outcome, r.resolved, r.fetched_at and r.fetched_at // 1000 - ZERO) for r in found]
    assert len(rows) == len(set(rows)) and set(rows) == ANSWERS


def test_cache_key(spark):
    rows = [(" Panthera Leo", "Species", "en-US"), ("panthera leo", "species", "en"), ("panthera leo", "species", "DE_at"), ("x", None, None), ("x", "", "deu")]
    found = spark.createDataFrame(rows, "n string, r string, l string").select(registry.cache_key(F.col("n"), F.col("r"), F.col("l"))).collect()
    assert [r[0] for r in found] == ["panthera leo|species|en", "panthera leo|species|en", "panthera leo|species|de", "x||en", "x||en"]

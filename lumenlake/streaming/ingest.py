"""Streaming ingest: upserts in micro-batches with a table for rejected rows, and session bursts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenlake.operators.catalog import last_of, upserted
from lumenlake.plans.lineage import materialized

BUCKETS = 64


def upsert_batches(table: str, rejected: str, valid: Callable[[DataFrame], DataFrame], order: str, id_: str = "id", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows whose column `ok` from `valid` is false go to `rejected`, others replace those of their id.

    The table is partitioned by a hash of the id; a batch rewrites only the partitions that it touches. Of equal ids in
    a batch the last by `order` wins. A batch that runs again gives the same table, and its rejected rows replace their
    own earlier copy."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        judged = materialized(valid(batch), "batch")
        judged.filter("NOT ok").drop("ok").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        new = last_of(judged.filter("ok").drop("ok"), id_, order).withColumn("bucket", F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` rows at most
        if not touched:
            return
        try:
            old = spark.read.schema(new.schema).parquet(table).filter(F.col("bucket").isin(touched))
            whole = upserted(old, new, id_)
        except Exception as missing:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            whole = new
        materialized(whole, "table").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    return write


def bursts(frames: DataFrame, gap: str, late: str) -> DataFrame:
    """(scope, started, n, first_id): chains of frames(scope, ts, id) with gaps of `gap` at most, as sessions close."""
    sessions = frames.withWatermark("ts", late).groupBy("scope", F.session_window("ts", gap).alias("w"))
    return sessions.agg(F.count("*").alias("n"), F.min("id").alias("first_id")).select("scope", F.unix_micros("w.start").alias("started"), "n", "first_id")


def run_once(stream: DataStreamWriter, checkpoint: str, config: dict[str, str] | None = None) -> None:
    """All that has arrived is processed, then the query ends. The session has the settings of `config` meanwhile."""
    spark, config = SparkSession.active(), config or {}
    before = {k: spark.conf.get(k, None) for k in config}
    for k, v in config.items():
        spark.conf.set(k, v)
    query = None
    try:
        query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if query is not None:
            query.stop()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

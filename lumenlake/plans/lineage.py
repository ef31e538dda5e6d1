"""Cutting lineage: results that several later steps use are written once to a folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir; on one machine, where that is unset, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            place = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def materialized(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later plans start from files that outlive executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(df: DataFrame) -> DataFrame:
    """`df`, which must be written already. Shuffle files of finished steps stay on executors' disks until the driver
    collects garbage, which it may not do for long; after a step that shuffled much this asks for it."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` written once to the shared folder, dealt by `key` as a shuffle would: joins by it shuffle the other side only.
    Of rows of one key one stays."""
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key).dropDuplicates([key]).write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}")
    dealt.bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)

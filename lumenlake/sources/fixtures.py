"""Fixtures of labelled groups: nested JSON, one fixture in each text, into a row for each labelled photo.

Texts that aren't such JSON are set apart with a reason, and don't end the load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.scalar import hash64

_PHOTO = "photo_id: string, filename: string, capture_time: double, phash: string, embedding: array<float>, metadata: variant, rank: long, reject: boolean"
_GROUP = f"group_id: string, intentional_set: string, photos: array<struct<{_PHOTO}>>"
SCHEMA = f"name string, notes string, culling_preset string, time_delta_seconds long, groups_are_authoritative boolean, groups array<struct<{_GROUP}>>, _broken string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of files, one fixture in each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def parsed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled photos of texts(source, text), and (source, reason) of the texts that are no fixtures.

    Photos: (fixture, preset, time_delta, authoritative, group_id, intentional_set, at, photo_id, filename, capture_time,
    hash, embedding, metadata, rank, reject), `at` being the place in the group. A fixture that doesn't say whether its
    groups are a human judgement is taken not to be; a hash that isn't hexadecimal is none."""
    whole = texts.select("source", F.from_json("text", SCHEMA, {"columnNameOfCorruptRecord": "_broken"}).alias("f")).select("source", "f.*")
    nameless = F.exists("groups", lambda g: g["group_id"].isNull() | g["photos"].isNull() | F.exists(g["photos"], lambda p: p["photo_id"].isNull()))
    reason = (
        F.when(F.col("_broken").isNotNull() | (F.col("name").isNull() & F.col("groups").isNull()), "no fixture")
        .when(F.col("name").isNull(), "no name")
        .when(F.col("groups").isNull(), "no groups")
        .when(nameless, "a group or photo without an id")
    )
    judged = whole.withColumn("reason", reason)
    groups = judged.filter("reason IS NULL").select(
        F.col("name").alias("fixture"),
        F.coalesce("culling_preset", F.lit("default")).alias("preset"),
        F.col("time_delta_seconds").alias("time_delta"),
        F.coalesce("groups_are_authoritative", F.lit(False)).alias("authoritative"),
        F.explode("groups").alias("g"),
    )
    photos = groups.select("fixture", "preset", "time_delta", "authoritative", "g.group_id", "g.intentional_set", F.posexplode("g.photos").alias("at", "p"))
    name = F.when(F.coalesce("p.filename", F.lit("")) != "", F.col("p.filename")).otherwise(F.concat("p.photo_id", F.lit(".jpg")))
    hashed = F.when(F.col("p.phash").rlike("^[0-9A-Fa-f]{1,16}$"), hash64(F.col("p.phash")))
    rows = photos.select(
        "fixture", "preset", "time_delta", "authoritative", "group_id", "intentional_set", "at", "p.photo_id", name.alias("filename"), "p.capture_time", hashed.alias("hash"), "p.embedding", "p.metadata",
        "p.rank", F.coalesce("p.reject", F.lit(False)).alias("reject"),
    )
    return rows, judged.filter("reason IS NOT NULL").select("source", "reason")

"""Registered queries of streams: run over what is there, and read back from the tables they write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.lineage import shared_folder
from lumenlake.streaming import ingest, registry

_DAY = 24 * 60 * 60


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files. A stream reads folders or patterns, so the last letter of the name is one."""
    path = f"{sf_dir}/events.parque[t]"
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(path)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def streamed_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of an hour's gap that the watermark has closed."""
    out = _place(spark, "bursts")
    frames = _events(spark, sf_dir).select(F.col("user_id").alias("scope"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    found = ingest.bursts(frames, "1 hour", "0 seconds")
    ingest.run_once(found.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table"), f"{out}/state")
    return spark.read.schema(found.schema).parquet(f"{out}/table")


def streamed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event; errors are rejected."""
    out = _place(spark, "upserts")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("id"), "event_id", "event_type", "value")
    sink = ingest.upsert_batches(f"{out}/table", f"{out}/rejected", lambda b: b.withColumn("ok", F.col("event_type") != "error"), "event_id")
    ingest.run_once(rows.writeStream.foreachBatch(sink), f"{out}/state")
    return spark.read.parquet(f"{out}/table").select("id", "event_id", "event_type", "value")


def _appended(spark: SparkSession, found: DataFrame, name: str) -> DataFrame:
    out = _place(spark, name)
    ingest.run_once(found.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table"), f"{out}/state", registry.CONFIG)
    return spark.read.schema(found.schema).parquet(f"{out}/table")


def streamed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs that wait three days for news; their clicks are polls."""
    kinds = F.create_map(*(F.lit(x) for pair in {"signup": "create", "view": "progress", "purchase": "done", "error": "error", "click": "poll"}.items() for x in pair))
    news = _events(spark, sf_dir).select(
        F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("position"), kinds[F.col("event_type")].alias("kind"), F.col("value").alias("number"), F.col("props").alias("text")
    )
    return _appended(spark, registry.polled_jobs(news, patience=3 * _DAY), "jobs")


def streamed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lookups of taxa: errors are names that nobody knows, clicks are lookups that fail."""
    answer = F.when(F.col("event_type") != "click", F.col("event_type") != "error")
    key = registry.cache_key(F.concat(F.lit("Taxon "), (F.col("user_id") % 60).cast("string")), F.lit("Species"), F.lit("en-US"))
    lookups = _events(spark, sf_dir).select(key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("position"), answer.alias("answer"))
    return _appended(spark, registry.remembered(lookups, resolved=5 * _DAY, unresolved=_DAY), "lookups")


QUERIES = {f.__name__: f for f in (streamed_bursts, streamed_upserts, streamed_jobs, streamed_lookups)}

SQL = {
    "streamed_bursts": """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
g AS (SELECT user_id AS scope, epoch_us(min(ts)) AS started, count(*) AS n, min(event_id) AS first_id, max(ts) AS last FROM s GROUP BY user_id, k)
SELECT scope, started, n, first_id FROM g WHERE last + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
    "streamed_upserts": """
SELECT user_id AS id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1""",
    "streamed_jobs": f"""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS job, epoch_us(ts) // 1000 AS t, event_id AS p, event_type AS k, value AS v, props AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS p, '' AS k, false AS gone, CAST(NULL AS BIGINT) AS gone_at,
  CAST(NULL AS VARCHAR) AS st0, CAST(NULL AS DOUBLE) AS re0, CAST(NULL AS VARCHAR) AS er0, CAST(NULL AS DOUBLE) AS pr0,
  CAST(NULL AS VARCHAR) AS st, CAST(NULL AS DOUBLE) AS re, CAST(NULL AS VARCHAR) AS er, CAST(NULL AS DOUBLE) AS pr, CAST(NULL AS BIGINT) AS ends FROM e
UNION ALL
SELECT job, n, t, p, k, ends IS NOT NULL AND NOT alive, ends, CASE WHEN ends IS NOT NULL THEN st END, re, er, pr,
  CASE WHEN k = 'signup' THEN 'running' WHEN NOT alive THEN NULL WHEN k = 'purchase' THEN 'done' WHEN k = 'error' THEN 'error' ELSE st END,
  CASE WHEN k = 'signup' THEN NULL WHEN k = 'purchase' THEN v ELSE re END, CASE WHEN k = 'signup' THEN NULL WHEN k = 'error' THEN x ELSE er END, CASE WHEN k = 'signup' THEN NULL WHEN k = 'view' THEN v ELSE pr END,
  CASE WHEN k = 'signup' OR alive AND (k <> 'click' OR st = 'running') THEN t + {3 * _DAY * 1000} + 1 END
FROM (SELECT e.*, s.st, s.re, s.er, s.pr, s.ends, coalesce(e.t < s.ends, false) AS alive FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1)),
w AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)
SELECT job, t AS at, p AS position, CASE WHEN gone OR st0 IS NULL THEN 'missing' ELSE st0 END AS status, CASE WHEN NOT gone AND st0 IS NOT NULL THEN re0 END AS result, CASE WHEN NOT gone AND st0 IS NOT NULL THEN er0 END AS error, CASE WHEN NOT gone AND st0 IS NOT NULL THEN pr0 END AS progress FROM s WHERE k = 'click'
UNION ALL SELECT job, gone_at, NULL, 'expired', re0, er0, pr0 FROM s WHERE gone
UNION ALL SELECT job, ends, NULL, 'expired', re, er, pr FROM s, w WHERE ends <= now AND n = (SELECT max(n) FROM e WHERE e.job = s.job)""",
    "streamed_lookups": f"""
WITH RECURSIVE e AS (SELECT 'taxon ' || user_id % 60 || '|species|en' AS key, epoch_us(ts) // 1000 AS t, event_id AS p, CASE event_type WHEN 'click' THEN NULL ELSE event_type <> 'error' END AS a, row_number() OVER (PARTITION BY user_id % 60 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS p, '' AS outcome, CAST(NULL AS BOOLEAN) AS known, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS ends FROM e
UNION ALL
SELECT key, n, t, p, CASE WHEN alive AND known THEN 'hit' WHEN alive THEN 'remembered_miss' WHEN a IS NULL THEN 'failed' ELSE 'fetched' END,
  CASE WHEN alive THEN known ELSE a END, CASE WHEN alive THEN since WHEN a IS NOT NULL THEN t END, CASE WHEN alive THEN ends WHEN a THEN t + {5 * _DAY * 1000} WHEN NOT a THEN t + {_DAY * 1000} END
FROM (SELECT e.*, s.known, s.since, s.ends, coalesce(e.t < s.ends, false) AS alive FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))
SELECT key, t AS at, p AS position, outcome, known AS resolved, since AS fetched_at FROM s WHERE n > 0""",
}

"""Registered queries of imports, migrations and reports on fixtures, with SQL. Events are labelled frames, parts and
suppliers bring metadata, vectors come from an old store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import imports, reports
from lumenlake.plans.lineage import materialized
from lumenlake.plans.search import table
from lumenlake.sources import fixtures


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("fixture_"), (F.col("user_id") % 4).cast("string")).alias("fixture"),
        F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("group_id"),
        F.when(F.col("user_id") % 9 == 0, "bracket").alias("intentional_set"),
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("photo_id"),
        F.when(F.col("event_id") % 3 == 0, 1 + F.col("event_id") % 4).alias("rank"),
        (F.col("event_type") == "error").alias("reject"),
        F.hour("ts").alias("hour"),
        "event_id", "user_id", "value",
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures as JSON, as they would stand in files: a file for each user, so none grows with the table."""
    photo = F.struct("event_id", F.struct("photo_id", F.col("event_id").cast("double").alias("capture_time"), "rank", "reject").alias("p"))
    groups = _events(spark, sf_dir).groupBy("fixture", "user_id", "group_id", "intentional_set").agg(F.transform(F.array_sort(F.collect_list(photo)), lambda x: x["p"]).alias("photos"))
    whole = groups.groupBy(F.col("fixture").alias("name"), "user_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "intentional_set", "photos"))).alias("groups"))
    said = F.when(F.col("name") != "fixture_3", F.col("name") != "fixture_2")
    return whole.select(F.concat_ws("_", "name", F.col("user_id").cast("string")).alias("source"), F.to_json(F.struct("name", said.alias("groups_are_authoritative"), "groups")).alias("text"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, _ = fixtures.parsed(_texts(spark, sf_dir))
    labels = materialized(photos.select("fixture", "authoritative", "group_id", "intentional_set", "at", "photo_id", "rank", "reject"), "labels")
    produced = _events(spark, sf_dir).filter("event_id % 50 <> 0").select(
        "fixture", "photo_id", F.concat_ws("_", "group_id", (F.col("hour") >= 12).cast("string")).alias("group"), F.floor("value").cast("double").alias("score"), (F.col("value") < 10).alias("reject"), (F.col("user_id") % 18 == 0).alias("keep_all")
    )
    return reports.reports(labels, produced)


_SHARES = ("winner_accuracy", "ndcg", "reject_precision", "reject_recall", "set_preservation", "set_recognition", "grouping_precision", "grouping_recall")


def fixture_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.measured(_reports(spark, sf_dir))
    return out.select("fixture", *reports.COUNTS, *(F.round(c, 6).alias(c) for c in _SHARES))


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.measured(reports.corpus(_reports(spark, sf_dir), "corpus"))
    return out.select("fixture", *reports.COUNTS, *(F.round(c, 6).alias(c) for c in _SHARES))


#: What a part brings as an item, in words that Spark and DuckDB have in common.
ITEM = """CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN '{"photo_id":"photo_' || p_partkey || '","title":"' || p_name || '","keywords":["' || p_type || '",{"name":"' || p_brand || '"}]}'
WHEN 1 THEN '{"uuid":"photo_' || (p_partkey - 1) || '","caption":"' || p_type || '","title":""}' WHEN 2 THEN '{"photo_id":"photo_' || p_partkey || '","keywords":{}}'
WHEN 3 THEN '["photo"]' WHEN 4 THEN '{"photo_id":"","title":"x"}' WHEN 5 THEN '{"photo_id":"photo_' || (p_partkey - 5) || '","title":"' || p_brand || '","alt_text":7}'
WHEN 6 THEN '{"photo_id":"new_' || p_partkey || '","uuid":"u' || p_partkey || '","keywords":{"' || p_type || '":["' || p_brand || '"]}}' ELSE '{' END"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.expr(ITEM).alias("item"))


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items had each outcome, and the counts that were observed while they were written."""
    rows, counts = imports.judged_items(_items(spark, sf_dir))
    found = rows.groupBy("outcome").agg(F.count("*").alias("n"))
    return found.withColumn("observed", F.when(F.col("outcome") == "imported", counts["imported"]).otherwise(counts["failed"]).cast("long"))


def metadata_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are laid over photos that know their title and another catalog."""
    rows, _ = imports.judged_items(_items(spark, sf_dir))
    known = table(spark, sf_dir, "part").filter("p_partkey % 16 < 9")
    photos = known.select(F.concat(F.lit("photo_"), F.col("p_partkey").cast("string")).alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.create_map(F.lit("title"), F.lit("old"), F.lit("catalog_ids"), F.lit('["b"]')).alias("metadata"))
    out = imports.imported(photos, rows, "2024-01-01 00:00:00", "a")
    at = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return out.select("id", *map(at, ("title", "caption", "keywords", "flattened_keywords", "uuid", "run_date", "photo_id", "catalog_ids")))


def _migration(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    name = F.when(n % 10 == 9, "old_notes").when(n % 2 == 0, "images").otherwise("faces").alias("table")
    vector = F.when(n % 7 == 1, F.slice("embedding", 1, 3)).when(n % 7 != 2, F.col("embedding"))
    records = e.select(name, n.alias("id"), vector.alias("vector"), F.when(n % 5 == 0, False).when(n % 5 < 4, True).alias("has_embedding"), F.lit("{}").alias("metadata"))
    log = e.filter(n % 3 == 0).select(name, n.alias("id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"), "embedding")
    log = log.select("table", "id", "seq", F.when((F.col("seq") == 2) & (F.col("id") % 4 == 0), "delete").otherwise("write").alias("op"), F.when((F.col("seq") == 1) & (F.col("id") % 2 == 0), F.col("embedding")).alias("vector"))
    dims = e.select(F.size("embedding")).first()[0]
    return imports.migrated(records, log, {"images": dims, "faces": dims})


def store_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records of an old store kept a vector, and which must be embedded anew."""
    rows, counts, _ = _migration(spark, sf_dir)
    imports.verified(counts).count()
    return rows.select("table", "id", F.size("vector").alias("length"), "needs_reembedding")


def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts, skipped = _migration(spark, sf_dir)
    return imports.verified(counts).unionByName(skipped.select("table", F.col("records").alias("source"), F.lit(0).cast("long").alias("migrated"), F.lit(0).cast("long").alias("needs_reembedding")))


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the order in which they first come, each once."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("id"))
    return imports.in_order(e)


def link_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's last event, those that are still good at noon of the sixth day: found for a day, errors for two hours."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.col("event_type") != "error").alias("resolved"), F.col("ts").alias("fetched_at"), "event_id").filter("fetched_at <= timestamp'2024-01-06 12:00:00'")
    return imports.cached(e, "2024-01-06 12:00:00", 86400, 7200).select("key", "resolved", "event_id")


_LABELLED = """e AS (SELECT *, 'fixture_' || user_id % 4 AS fixture, user_id || '_' || CAST(ts AS DATE) AS g, CASE WHEN user_id % 9 = 0 THEN 'bracket' END AS s, 'p' || event_id AS photo, CASE WHEN event_id % 3 = 0 THEN 1 + event_id % 4 END AS rank,
  event_type = 'error' AS bad, user_id % 4 < 2 AS human, event_id % 50 <> 0 AS made, user_id || '_' || CAST(ts AS DATE) || '_' || (hour(ts) >= 12) AS produced, floor(value) AS score, value < 10 AS rejected, user_id % 18 = 0 AS keep FROM events),
l AS (SELECT *, count(*) OVER (PARTITION BY fixture, g) AS size, CASE WHEN rank BETWEEN 1 AND count(*) OVER (PARTITION BY fixture, g) THEN count(*) OVER (PARTITION BY fixture, g) + 1 - rank ELSE 0 END AS gain FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY fixture, g ORDER BY CASE WHEN made THEN score ELSE 0 END DESC, photo) AS place, row_number() OVER (PARTITION BY fixture, g ORDER BY gain DESC) AS best FROM l WHERE s IS NULL),
r AS (SELECT fixture, g, max(size) > 1 AND coalesce(bool_or(rank = 1), false) AS counts, coalesce(bool_or(place = 1 AND rank = 1), false) AS hit, coalesce(sum(gain / log2(place + 1)) / nullif(sum(gain / log2(best + 1)), 0), 0) AS ndcg, count(*) FILTER (bad) AS bad FROM o GROUP BY 1, 2),
ranked AS (SELECT fixture, count(*) FILTER (counts) AS ranked_groups, count(*) FILTER (counts AND hit) AS winner_hits, coalesce(sum(ndcg) FILTER (counts), 0) AS ndcg_sum, sum(bad)::BIGINT AS rejects_labelled FROM r GROUP BY 1),
size_made AS (SELECT produced, count(*) AS n FROM e WHERE made GROUP BY 1),
sets AS (SELECT fixture, g, bool_and(made AND NOT rejected) AS preserved, count(DISTINCT produced) FILTER (made) = 1 AND bool_and(keep) AND arg_min(made, event_id) AND arg_min(n, event_id) = count(*) AS recognised FROM e LEFT JOIN size_made USING (produced) WHERE s IS NOT NULL GROUP BY 1, 2),
kept AS (SELECT fixture, count(*) AS sets_labelled, count(*) FILTER (preserved) AS sets_preserved, count(*) FILTER (recognised) AS sets_recognised FROM sets GROUP BY 1),
rejects AS (SELECT fixture, count(*) AS rejects_predicted, count(*) FILTER (bad) AS rejects_correct FROM e WHERE made AND rejected GROUP BY 1),
pp AS (SELECT fixture, sum(n * (n - 1) // 2)::BIGINT AS pairs_predicted FROM (SELECT fixture, count(*) AS n FROM e WHERE made AND human GROUP BY fixture, produced) GROUP BY 1),
pl AS (SELECT fixture, sum(n * (n - 1) // 2)::BIGINT AS pairs_labelled FROM (SELECT fixture, count(*) AS n FROM e WHERE human GROUP BY fixture, g) GROUP BY 1),
pc AS (SELECT fixture, sum(n * (n - 1) // 2)::BIGINT AS pairs_correct FROM (SELECT fixture, count(*) AS n FROM e WHERE made AND human GROUP BY fixture, g, produced) GROUP BY 1),
each AS (SELECT fixture, coalesce(ranked_groups, 0) AS ranked_groups, coalesce(winner_hits, 0) AS winner_hits, coalesce(rejects_predicted, 0) AS rejects_predicted, coalesce(rejects_labelled, 0) AS rejects_labelled, coalesce(rejects_correct, 0) AS rejects_correct,
  coalesce(sets_labelled, 0) AS sets_labelled, coalesce(sets_preserved, 0) AS sets_preserved, coalesce(sets_recognised, 0) AS sets_recognised, coalesce(pairs_predicted, 0) AS pairs_predicted, coalesce(pairs_labelled, 0) AS pairs_labelled,
  coalesce(pairs_correct, 0) AS pairs_correct, coalesce(ndcg_sum, 0) AS ndcg_sum
  FROM (SELECT DISTINCT fixture FROM e) LEFT JOIN ranked USING (fixture) LEFT JOIN kept USING (fixture) LEFT JOIN rejects USING (fixture) LEFT JOIN pp USING (fixture) LEFT JOIN pl USING (fixture) LEFT JOIN pc USING (fixture))"""
_MEASURED = "SELECT fixture, " + ", ".join(reports.COUNTS) + "".join(
    f", round(coalesce({a} / nullif({b}, 0), 0), 6) AS {n}"
    for n, a, b in (
        ("winner_accuracy", "winner_hits", "ranked_groups"), ("ndcg", "ndcg_sum", "ranked_groups"), ("reject_precision", "rejects_correct", "rejects_predicted"), ("reject_recall", "rejects_correct", "rejects_labelled"),
        ("set_preservation", "sets_preserved", "sets_labelled"), ("set_recognition", "sets_recognised", "sets_labelled"), ("grouping_precision", "pairs_correct", "pairs_predicted"), ("grouping_recall", "pairs_correct", "pairs_labelled"),
    )
)

QUERIES = {f.__name__: f for f in (fixture_reports, corpus_report, import_outcomes, metadata_import, store_migration, migration_counts, request_ids, link_cache)}

_STORE = """s AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 9 THEN 'old_notes' WHEN vec_id % 2 = 0 THEN 'images' ELSE 'faces' END AS "table", len(embedding) AS d,
  CASE WHEN vec_id % 7 = 1 THEN 3 WHEN vec_id % 7 <> 2 THEN len(embedding) END AS stored, vec_id % 5 <> 0 AS claims, vec_id % 3 = 0 AS logged FROM embeddings),
v AS (SELECT *, CASE WHEN logged AND id % 4 = 0 THEN NULL WHEN logged AND id % 2 = 0 THEN d ELSE stored END AS now FROM s),
m AS (SELECT "table", id, CASE WHEN claims AND now = d THEN d END AS length, claims AND coalesce(now <> d, true) AS needs_reembedding FROM v WHERE "table" <> 'old_notes')"""

SQL = {
    "fixture_reports": f"WITH {_LABELLED} {_MEASURED} FROM each",
    "corpus_report": f"WITH {_LABELLED}, a AS (SELECT 'corpus' AS fixture, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in reports.COUNTS) + f", sum(ndcg_sum) AS ndcg_sum FROM each) {_MEASURED} FROM a",
    "import_outcomes": """WITH o AS (SELECT CASE WHEN p_partkey % 8 IN (3, 7) THEN 'no object' WHEN p_partkey % 8 = 4 THEN 'no id' WHEN p_partkey % 8 = 2 THEN 'no metadata' ELSE 'imported' END AS outcome FROM part)
SELECT outcome, count(*) AS n, CASE WHEN outcome = 'imported' THEN (SELECT count(*) FROM o WHERE outcome = 'imported') ELSE (SELECT count(*) FROM o WHERE outcome <> 'imported') END AS observed FROM o GROUP BY 1""",
    "metadata_import": """WITH i AS (SELECT p_partkey AS n, p_partkey // 8 * 8 AS base, p_partkey % 8 AS k, * FROM part),
c AS (
  SELECT 'photo_' || base AS id, arg_max(CASE k WHEN 0 THEN p_name ELSE p_brand END, n) FILTER (k IN (0, 5)) AS title, arg_max(p_type, n) FILTER (k = 1) AS caption,
    arg_max('["' || p_type || '",{"name":"' || p_brand || '"}]', n) FILTER (k = 0) AS keywords, arg_max(p_type || ', ' || p_brand, n) FILTER (k = 0) AS flattened_keywords, 'photo_' || base AS uuid
  FROM i WHERE k IN (0, 1, 5) GROUP BY base
  UNION ALL SELECT 'new_' || n, NULL, NULL, '{"' || p_type || '":["' || p_brand || '"]}', p_type || ', ' || p_brand, 'u' || n FROM i WHERE k = 6
),
o AS (SELECT 'photo_' || p_partkey AS id, 'old' AS title, '["b"]' AS ids FROM part WHERE p_partkey % 16 < 9)
SELECT coalesce(o.id, c.id) AS id, coalesce(c.title, o.title) AS title, caption, keywords, flattened_keywords, uuid, CASE WHEN c.id IS NOT NULL THEN '2024-01-01 00:00:00' END AS run_date,
  CASE WHEN c.id IS NOT NULL THEN uuid END AS photo_id, CASE WHEN c.id IS NULL THEN o.ids WHEN o.id IS NULL THEN '["a"]' ELSE '["a","b"]' END AS catalog_ids FROM o FULL JOIN c ON o.id = c.id""",
    "store_migration": f"WITH {_STORE} SELECT * FROM m",
    "migration_counts": f"""WITH {_STORE} SELECT "table", count(*) AS source, count(*) AS migrated, count(*) FILTER (needs_reembedding) AS needs_reembedding FROM m GROUP BY 1
UNION ALL SELECT "table", count(*), 0, 0 FROM s WHERE "table" = 'old_notes' GROUP BY 1""",
    "request_ids": "SELECT min(event_id) AS position, user_id::VARCHAR AS id FROM events WHERE event_type <> 'error' GROUP BY user_id",
    "link_cache": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-06 12:00:00')
SELECT user_id::VARCHAR AS key, event_type <> 'error' AS resolved, event_id FROM e WHERE k = 1 AND TIMESTAMP '2024-01-06 12:00:00' - ts < CASE WHEN event_type <> 'error' THEN INTERVAL 1 DAY ELSE INTERVAL 2 HOUR END""",
}

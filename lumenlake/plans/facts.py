"""Registered queries of facts of groups and kinds of sets, of replies and names that are parsed with tolerance, and of scene
tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.functions import parsing, scalar
from lumenlake.operators import facts, grouping, ranking, replies, style, taxonomy
from lumenlake.plans.search import photos, table

_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


def group_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, their types as groups of thousands; half of them have a vector, and some no hash or time."""
    e, v = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    frames = e.join(v, F.pmod(e.event_id, F.lit(1000)) == v.vec_id, "left").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("group"), F.when(F.col("event_id") % 13 != 0, scalar.epoch_seconds(F.col("ts"))).alias("time"),
        F.when(F.col("event_id") % 11 != 0, F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))).alias("hash"), F.col("embedding").alias("vector"),
    )
    kind = F.when(F.col("event_id") % 3 == 0, "near_duplicate").when(F.col("event_id") % 3 == 1, "burst").otherwise("bracket_candidate")
    links = e.filter("event_type <> 'view' OR event_id % 3 = 0").select(F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"), kind.alias("kind"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_distance", "nearest", "furthest", "mean_bits")]
    return facts.group_facts(frames, links).select(
        "group", "size", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "span", F.array_join("edge_types", ",").alias("edge_types"),
        "n_distances", "n_hash_distances", "fewest_bits", "most_bits", *rounded,
    )


def cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames half a second apart without hashes; every tenth has no time, every third an exposure."""
    n = F.col("id")
    frames = photos(spark, sf_dir).select(
        "id", F.when(n % 10 != 0, n * 0.5).alias("time"), F.lit(None).cast("long").alias("hash"), "vector", F.when(n % 3 == 0, (n % 2).cast("double")).alias("ev")
    )
    return grouping.edges(frames, grouping.Thresholds(3.0, 0.9, 0, 0.5, 12.0)).select("a", "b", "gap", "kind")


def set_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events each as frames: cameras that turn by steps of different width, sharp regions that move, and exposures."""
    n = F.col("event_id")
    g, j = F.floor(n / 4), n % 4
    angle = j * (g % 7 * 0.1 + 0.25)
    frames = table(spark, sf_dir, "events").select(
        g.alias("group_id"), n.alias("id"), j.cast("double").alias("time"), F.when(g % 11 == 0, j.cast("double")).alias("ev"), F.when(g % 2 == 0, F.pmod(n * 2654435761, F.lit(4294967296))).otherwise(g).alias("hash"),
        F.array(F.cos(angle), F.sin(angle)).alias("vector"), F.when(g % 3 == 0, j * (g % 5) * 0.021).alias("x"), F.when(g % 3 == 0, 0.5).alias("y"),
    )
    return ranking.intentional_sets(frames)


_CONFIRMED = "p_partkey % 2 = 0 AND p_partkey % 4 <> 0"
_KIND = "CAST((chunk + CAST(split_part(list, '#', 2) AS INT)) % 6 AS INT)"


def cluster_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts as groups, brands as lists. Replies confirm some groups; they are fenced, wrapped in prose, broken off,
    absent, too long, or hold no list."""
    p = table(spark, sf_dir, "part")
    at = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("position")
    rows = p.select(F.col("p_brand").alias("list"), at, F.expr(f"CASE WHEN p_partkey % 4 <> 0 THEN array({_W1}, {_W2}) ELSE array({_W1}) END").alias("members"), F.expr(_CONFIRMED).alias("agreed"))
    item = F.when(F.col("agreed"), F.to_json(F.array(F.upper(F.get("members", F.lit(0))), F.concat(F.lit(" "), F.get("members", F.lit(1)), F.lit("]"))))).otherwise("[]")
    told = replies.chunked(rows.withColumn("members", F.array(item))).withColumn("j", F.array_join(F.flatten("groups"), ","))
    said = F.expr(f"""CASE {_KIND} WHEN 0 THEN '```json\n[' || j || ']\n```' WHEN 1 THEN 'Here: [' || j || '] done ] ok' WHEN 2 THEN '[' || j
        WHEN 4 THEN '[' || j || ',["x","y"]]' WHEN 5 THEN 'no list' END""")
    found = replies.validated(rows, told.select("list", "chunk", said.alias("reply")))
    return found.select("list", "chunk", "n", F.array_join("members", "|").alias("members"), "confirmed")


_GENUS = f"CASE CAST(p_partkey % 8 AS INT) WHEN 5 THEN 'unclassified ' || {_W1} ELSE upper(substr({_W1}, 1, 1)) || substr({_W1}, 2) END"
_SPECIES = f"""CASE CAST(p_partkey % 8 AS INT) WHEN 1 THEN {_W2} || ' Hudson ex Withering, 1801' WHEN 2 THEN upper(substr({_W1}, 1, 1)) || substr({_W1}, 2) || ' ' || {_W2}
WHEN 3 THEN 'sp. BOLD:' || p_partkey WHEN 4 THEN 'CF. ' || {_W2} WHEN 6 THEN upper({_W2}) WHEN 7 THEN 'x-' || {_W2} || '  var. minor' ELSE {_W2} END"""


def taxon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as taxa with authorities, whole binomials, open nomenclature and unusable genera."""
    taxa = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_GENUS).alias("genus"), F.expr(_SPECIES).alias("species"))
    return taxonomy.cleaned(taxa)


_TASKS = "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN '[\"' || c_mktsegment || '\",\"faces\"]' WHEN 1 THEN 'faces, ' || c_mktsegment WHEN 2 THEN '' WHEN 3 THEN '[' || c_mktsegment || ',faces' END"


def task_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_TASKS).alias("text"))
    return rows.select("id", F.array_join(parsing.tasks(F.col("text")), "|").alias("tasks"))


def scene_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve vectors stand in for what the probes' texts say."""
    p = photos(spark, sf_dir)
    said = [list(r.vector) for r in p.filter(F.col("id") < len(style.SCENES)).orderBy("id").select("vector").collect()]  # twelve rows
    return p.select("id", F.array_join(style.scene_tags(F.col("vector"), said), ",").alias("tags"))


QUERIES = {f.__name__: f for f in (group_facts, cosine_edges, set_kinds, cluster_replies, taxon_names, task_lists, scene_tags)}

_TAGS = ", ".join(f"'{s}'" for s in style.SCENES)
SQL = {
    "group_facts": """
WITH f AS (SELECT event_id AS id, event_type AS "group", CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) / 1e6 END AS t, CASE WHEN event_id % 11 <> 0 THEN (event_id * 2654435761) % 4294967296 END AS h, embedding::DOUBLE[] AS v, event_id % 3 AS k
  FROM events LEFT JOIN embeddings ON event_id % 1000 = vec_id),
d AS (SELECT a."group", greatest(0, 1 - list_cosine_similarity(a.v, b.v)) AS d FROM f a JOIN f b ON a."group" = b."group" AND a.id < b.id AND a.v IS NOT NULL AND b.v IS NOT NULL),
x AS (SELECT "group", count(*) AS n_distances, round(avg(d), 6) AS mean_distance, round(min(d), 6) AS nearest, round(max(d), 6) AS furthest FROM d GROUP BY 1),
c AS (SELECT a."group", bit_count(xor(a.h, b.h)) AS d FROM f a JOIN f b ON a."group" = b."group" AND a.id < b.id AND a.h IS NOT NULL AND b.h IS NOT NULL),
y AS (SELECT "group", count(*) AS n_hash_distances, round(avg(d), 6) AS mean_bits, CAST(min(d) AS INT) AS fewest_bits, CAST(max(d) AS INT) AS most_bits FROM c GROUP BY 1),
l AS (SELECT a."group", CASE a.k WHEN 0 THEN 'near_duplicate' WHEN 1 THEN 'burst' ELSE 'bracket_candidate' END AS kind FROM f a JOIN f b ON b.id = a.id + 1 AND a."group" = b."group" WHERE a."group" <> 'view' OR a.k = 0),
k AS (SELECT "group", string_agg(DISTINCT kind, ',' ORDER BY kind) AS edge_types FROM l GROUP BY 1),
s AS (SELECT "group", count(*) AS size, round(min(t), 3) AS first, round(max(t), 3) AS last, coalesce(round(max(t) - min(t), 3), 0) AS span FROM f GROUP BY 1)
SELECT s."group", size, first, last, span, coalesce(edge_types, '') AS edge_types, coalesce(n_distances, 0) AS n_distances, coalesce(n_hash_distances, 0) AS n_hash_distances, fewest_bits, most_bits, mean_distance, nearest, furthest, mean_bits
FROM s LEFT JOIN k USING ("group") LEFT JOIN x USING ("group") LEFT JOIN y USING ("group")""",
    "cosine_edges": """
WITH f AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 <> 0 THEN vec_id * 0.5::DOUBLE END AS t, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 3 = 0 THEN vec_id % 2 END AS ev FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, b.t - a.t AS gap, 1 - list_cosine_similarity(a.v, b.v) AS d, abs(a.ev - b.ev) > 0.34 AS apart FROM f a JOIN f b ON a.id < b.id WHERE a.t IS NULL OR b.t IS NULL OR b.t - a.t <= 12),
k AS (SELECT a, b, gap, CASE WHEN apart AND gap <= 3 THEN 'bracket_candidate' WHEN d <= 0.5 THEN 'near_duplicate' WHEN d <= 0.9 AND gap <= 3 THEN 'burst' END AS kind FROM p)
SELECT * FROM k WHERE kind IS NOT NULL""",
    "set_kinds": """
WITH f AS (SELECT event_id // 4 AS g, event_id AS id, CASE WHEN g % 2 = 0 THEN (event_id * 2654435761) % 4294967296 ELSE g END AS h FROM events),
s AS (SELECT a.g, bool_and(bit_count(xor(a.h, b.h)) <= 12) AS still FROM f a JOIN f b ON a.g = b.g GROUP BY 1),
n AS (SELECT g, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 3),
k AS (SELECT g AS group_id, CASE WHEN g % 11 = 0 THEN 'bracket' WHEN g % 3 = 0 AND still AND (n - 1) * (g % 5) * 0.021 >= 0.12 THEN 'focus_stack'
  WHEN NOT still AND 1 - cos(g % 7 * 0.1::DOUBLE + 0.25::DOUBLE) BETWEEN 0.06 AND 0.35 THEN 'panorama' END AS kind FROM n JOIN s USING (g))
SELECT * FROM k WHERE kind IS NOT NULL""",
    "cluster_replies": f"""
WITH p AS (SELECT p_brand AS list, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // {replies.CHUNK} AS INT) AS chunk, p_partkey, {_W1} AS x, {_W2} AS y FROM part),
k AS (SELECT *, {_KIND} IN (0, 1, 4) AS confirmed FROM p)
SELECT list, chunk, CAST(row_number() OVER (PARTITION BY list, chunk ORDER BY p_partkey) - 1 AS INT) AS n, CASE WHEN confirmed THEN upper(x) || '|' || y || ']' ELSE x || '|' || y END AS members, confirmed
FROM k WHERE CASE WHEN confirmed THEN {_CONFIRMED} ELSE p_partkey % 4 <> 0 END""",
    "taxon_names": f"""
WITH t AS (SELECT p_partkey AS id, {_GENUS} AS genus, {_SPECIES} AS species FROM part)
SELECT id, genus, CASE id % 8 WHEN 2 THEN split_part(species, ' ', 2) ELSE split_part(species, ' ', 1) END AS species FROM t WHERE id % 8 NOT IN (3, 4, 5, 6)""",
    "task_lists": """
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || '|faces' WHEN 1 THEN 'faces|' || c_mktsegment WHEN 3 THEN '[' || c_mktsegment || '|faces' ELSE 'embeddings' END AS tasks FROM customer""",
    "scene_tags": f"""
WITH s AS (SELECT a.vec_id AS id, b.vec_id AS k FROM embeddings a JOIN embeddings b ON b.vec_id < {len(style.SCENES)} AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= {style.SCENE_FLOOR}),
t AS (SELECT id, string_agg([{_TAGS}][k + 1], ',' ORDER BY k) AS tags FROM s GROUP BY 1)
SELECT vec_id AS id, coalesce(tags, '') AS tags FROM embeddings LEFT JOIN t ON id = vec_id""",
}

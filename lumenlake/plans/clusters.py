"""Registered queries of clustering and keywords; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import clustering, keywords
from lumenlake.plans.search import photos, table

#: Vectors of the test tables look random, so thresholds are wide; see the tests for the usual ones.
COSINE = 0.70


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dbscan(photos(spark, sf_dir), COSINE, 2)


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.near_pairs(photos(spark, sf_dir), COSINE).select("a", "b", F.round("distance", 6).alias("distance"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).withColumnRenamed("label", "cluster")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clustering.centroids(_labelled(spark, sf_dir))
    return c.select("cluster", "size", F.posexplode("centroid").alias("pos", "x")).select("cluster", "size", "pos", F.round("x", 6).alias("x"))


def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _labelled(spark, sf_dir)
    d = clustering.diagnostics(p, clustering.centroids(p).select("cluster", "centroid"))
    return d.select("cluster", "size", F.round("spread", 6).alias("spread"), F.round("nearest_other", 6).alias("nearest_other"))


def attach_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _labelled(spark, sf_dir)
    a = clustering.attached(p.select("id", "vector"), clustering.centroids(p).select("cluster", "centroid"), 0.72)
    return a.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.round("distance", 6).alias("distance"))


def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.agglomerated_whole(photos(spark, sf_dir), COSINE, block="label", linkage="average")


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as faces: some weak, some pinned to two persons, some pinned out."""
    pinned = F.when(F.col("id") % 50 == 3, F.concat(F.lit("person_"), (F.col("id") % 20).cast("string"))).when(F.col("id") % 50 == 4, "")
    return photos(spark, sf_dir).select(
        "id", "vector", (F.pmod(F.col("id") * 7, F.lit(13)) / 13.0).alias("quality"), (F.col("id") % 9 == 0).alias("weak"), pinned.alias("pinned"), (F.col("id") % 4 == 1).alias("unmeasured")
    )


def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered_faces(_faces(spark, sf_dir), cosine=COSINE)


def face_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.face_report(_faces(spark, sf_dir), face_clusters(spark, sf_dir))


def person_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of faces after a run; before it, faces had the persons of their labels."""
    old = photos(spark, sf_dir).filter("id % 3 <> 0").select(F.col("id").alias("face"), F.concat(F.lit("person_"), F.col("label").cast("string")).alias("person"))
    return clustering.stabilized(face_clusters(spark, sf_dir), old)


def person_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.person_count(person_ids(spark, sf_dir))


def face_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as faces, measured in part."""
    n = F.col("l_orderkey") + F.col("l_linenumber")
    why = clustering.weakness(F.when(n % 3 != 0, F.col("l_discount") * 4 + 0.7), F.when(n % 5 != 0, F.col("l_quantity") / 10000), F.when(n % 7 != 0, F.col("l_tax") * 3), F.when(n % 11 != 0, F.col("l_discount") * 6))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", why.alias("weak"))


def person_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    old = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("face"), F.concat(F.lit("person_"), (F.col("user_id") % 12).cast("string")).alias("person"))
    new = e.select(F.col("event_id").alias("face"), (F.col("user_id") % 15).alias("label"))
    return clustering.matched_persons(old, new)


def keyword_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cliques(photos(spark, sf_dir), 1 - COSINE)


def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as boxes of an image."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), F.col("l_quantity").alias("w"), F.col("l_quantity").alias("h"), F.col("l_extendedprice").alias("score")
    )
    return clustering.suppressed(rows).select("image", "id")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))


def keyword_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = keywords.deduplicated(_words(spark, sf_dir), "doc_id", "word", "pos")
    return first.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"), F.sum(F.length("word")).alias("chars"))


def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keywords.merged(_words(spark, sf_dir), "doc_id", "word", "pos", {"the": "The", "der": "die", "le": "la"})
    return k.select("doc_id", F.array_join("keywords", "|").alias("keywords"))


def message_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a user's run."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws(" ", "event_type", F.floor(F.col("value") / 20).cast("string")).alias("message"))
    return keywords.summaries(e, "user_id", "message", "event_id")


def vocab_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _words(spark, sf_dir).select(F.col("word").alias("name"), F.lit(1).alias("uses"), F.struct("doc_id", "pos").alias("position"))
    return keywords.vocabulary(uses, ["License", "nobody uses this", " LICENSE "], 50)


def sibling_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("name"), F.lit("world").alias("parent")))
    return keywords.siblings(tree).select("parent", F.array_join("leaves", ",").alias("leaves"))


_PAIRS = f"""n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, greatest(0, 1 - list_dot_product(a.v, b.v)) AS d FROM n a JOIN n b ON a.id < b.id WHERE 1 - list_dot_product(a.v, b.v) <= {COSINE})"""
_CENTERS = """x AS (SELECT label AS cluster, unnest(embedding::DOUBLE[]) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
s AS (SELECT cluster, pos, sum(x) AS x, count(*) AS size FROM x GROUP BY ALL),
c AS (SELECT cluster, max(size) AS size, list(x ORDER BY pos) AS raw FROM s GROUP BY 1),
u AS (SELECT cluster, size, list_transform(raw, lambda y: y / sqrt(list_dot_product(raw, raw))) AS v FROM c)"""

QUERIES = {
    f.__name__: f
    for f in (dbscan_labels, near_pairs, centroids, cluster_spread, attach_nearest, agglomerative, face_clusters, face_report, person_ids, person_total, face_gate, person_match, keyword_cliques, box_suppression, keyword_dedupe, keyword_merge, message_summary, vocab_rank, sibling_leaves)
}

SQL = {
    "near_pairs": f"WITH {_PAIRS} SELECT a, b, round(d, 6) AS distance FROM p",
    # Components by walking: at least one neighbour makes a core point, so a point's own component is its cluster.
    "dbscan_labels": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
w AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id WHERE e.b > w.root)
SELECT n.id, coalesce(min(w.root), -1)::BIGINT AS cluster FROM n LEFT JOIN w ON n.id = w.id GROUP BY 1""",
    "centroids": f"WITH {_CENTERS} SELECT cluster, size, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM (SELECT cluster, size, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos FROM u)",
    "cluster_spread": f"""WITH {_CENTERS},
d AS (SELECT label AS cluster, count(*) AS size, avg(greatest(0, 1 - list_dot_product(embedding::DOUBLE[], v))) AS spread FROM embeddings JOIN u ON label = cluster GROUP BY 1),
o AS (SELECT a.cluster, min(greatest(0, 1 - list_dot_product(a.v, b.v))) AS nearest_other FROM u a JOIN u b ON a.cluster <> b.cluster GROUP BY 1)
SELECT cluster, size, round(spread, 6) AS spread, round(nearest_other, 6) AS nearest_other FROM d LEFT JOIN o USING (cluster)""",
    "attach_nearest": f"""WITH {_CENTERS}, d AS (SELECT vec_id AS id, cluster, greatest(0, 1 - list_dot_product(embedding::DOUBLE[], v)) AS distance FROM embeddings, u)
SELECT id, CASE WHEN min(distance) <= 0.72 THEN arg_min(cluster, (distance, cluster)) ELSE -1 END AS cluster, round(min(distance), 6) AS distance FROM d GROUP BY 1""",
    "keyword_dedupe": """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
f AS (SELECT doc_id, min(pos) AS pos, arg_min(word, pos) AS word FROM w GROUP BY doc_id, lower(trim(word)))
SELECT doc_id, count(*) AS n, sum(pos)::BIGINT AS positions, sum(length(word))::BIGINT AS chars FROM f GROUP BY 1""",
    # Label by label, the largest first; `free` are a label's persons that nobody took.
    "person_match": """
WITH RECURSIVE e AS (SELECT event_id AS face, user_id % 15 AS label, CASE WHEN event_id % 3 <> 0 THEN 'person_' || (user_id % 12) END AS person FROM events),
s AS (SELECT label, row_number() OVER (ORDER BY count(DISTINCT face) DESC, label) AS k FROM e GROUP BY 1),
o AS (SELECT label, list(person ORDER BY n DESC, person) AS wanted FROM (SELECT label, person, count(DISTINCT face) AS n FROM e WHERE person IS NOT NULL GROUP BY ALL) GROUP BY 1),
q AS (SELECT s.k, s.label, coalesce(o.wanted, []::VARCHAR[]) AS wanted FROM s LEFT JOIN o USING (label)),
w AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS label, NULL::VARCHAR AS person, []::VARCHAR[] AS used UNION ALL
  SELECT k, label, free[1], CASE WHEN len(free) = 0 THEN used ELSE list_append(used, free[1]) END FROM (SELECT q.k, q.label, w.used, list_filter(q.wanted, lambda p: NOT list_contains(w.used, p)) AS free FROM w JOIN q ON q.k = w.k + 1)),
m AS (SELECT max(substr(person, 8)::BIGINT) AS last FROM e)
SELECT label, coalesce(person, 'person_' || (last + row_number() OVER (PARTITION BY person IS NULL ORDER BY k))) AS person FROM w, m WHERE k > 0""",
    # Boxes of an image from the best down; `kept` are those that stayed.
    "box_suppression": """
WITH RECURSIVE b AS (SELECT l_orderkey AS image, l_linenumber::BIGINT AS id, {'x': (l_partkey % 50)::DOUBLE, 'y': (l_suppkey % 50)::DOUBLE, 'w': l_quantity::DOUBLE, 'h': l_quantity::DOUBLE} AS r,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey % 50, l_suppkey % 50, l_quantity) AS k FROM lineitem),
w AS (SELECT image, k, id, TRUE AS stays, [r] AS kept FROM b WHERE k = 1 UNION ALL
  SELECT image, k, id, stays, CASE WHEN stays THEN list_append(kept, r) ELSE kept END FROM (SELECT b.image, b.k, b.id, b.r, w.kept, len(list_filter(w.kept, lambda q:
    greatest(0, least(q.x + q.w, b.r.x + b.r.w) - greatest(q.x, b.r.x)) * greatest(0, least(q.y + q.h, b.r.y + b.r.h) - greatest(q.y, b.r.y)) > 0.3 * greatest(1e-12, q.w * q.h + b.r.w * b.r.h
    - greatest(0, least(q.x + q.w, b.r.x + b.r.w) - greatest(q.x, b.r.x)) * greatest(0, least(q.y + q.h, b.r.y + b.r.h) - greatest(q.y, b.r.y))))) = 0 AS stays FROM w JOIN b ON b.image = w.image AND b.k = w.k + 1))
SELECT image, id FROM w WHERE stays""",
    "face_gate": """
WITH f AS (SELECT *, l_orderkey + l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n % 3 <> 0 AND l_discount * 4 + 0.7 < 0.80 THEN 'low detection confidence' WHEN n % 5 <> 0 AND l_quantity / 10000 < 0.0008 THEN 'too small in frame'
  WHEN n % 7 <> 0 AND l_tax * 3 < 0.12 THEN 'too blurry' WHEN n % 11 <> 0 AND l_discount * 6 > 0.55 THEN 'mostly hidden' END AS weak FROM f""",
    "keyword_merge": """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS k, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
r AS (SELECT doc_id, pos, CASE lower(k) WHEN 'the' THEN 'The' WHEN 'der' THEN 'die' WHEN 'le' THEN 'la' ELSE k END AS k FROM w),
f AS (SELECT doc_id, min(pos) AS pos, arg_min(k, pos) AS k FROM r GROUP BY doc_id, lower(trim(k)))
SELECT doc_id, string_agg(k, '|' ORDER BY pos) AS keywords FROM f GROUP BY 1""",
    "message_summary": """
WITH m AS (SELECT user_id, event_id, concat_ws(' ', event_type, floor(value / 20)::BIGINT) AS message FROM events),
f AS (SELECT user_id, message, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), message) AS n FROM m GROUP BY user_id, message)
SELECT user_id, string_agg(message, chr(10) ORDER BY n) FILTER (n <= 5) || CASE WHEN count(*) > 5 THEN chr(10) || '...and ' || (count(*) - 5) || ' more' ELSE '' END AS messages FROM f GROUP BY 1""",
    "vocab_rank": """
WITH w AS (SELECT doc_id, trim(unnest(string_split(text, ' '))) AS name, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
c AS (SELECT lower(name) AS key, arg_min(name, (doc_id, pos)) AS name, count(*) AS uses FROM w WHERE name <> '' GROUP BY 1)
SELECT 'License' AS name, coalesce((SELECT uses FROM c WHERE key = 'license'), 0) AS uses UNION ALL SELECT 'nobody uses this', 0
UNION ALL SELECT name, uses FROM (SELECT * FROM c WHERE key <> 'license' ORDER BY uses DESC, name LIMIT 48)""",
    "sibling_leaves": "SELECT r_name AS parent, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS leaves FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(DISTINCT n_name) >= 2",
}

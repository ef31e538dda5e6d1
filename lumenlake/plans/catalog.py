"""Registered queries of catalog upkeep, statistics and people, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import scalar
from lumenlake.operators import catalog
from lumenlake.plans.search import table


def owned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(F.col("source")).alias("catalogs"), "lang", "n_chars")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join("catalogs", ",").alias("catalogs"))


def ids_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with an embedding; where nothing is said, there is one."""
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("has_embedding"))
    return docs.join(e, "doc_id", "left").filter(F.coalesce("has_embedding", F.lit(True)) & (F.col("lang") == "en")).select("doc_id")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(i,) for i in (1, 5, 5, 32, 10**9)], "o_orderkey long")
    return catalog.get(table(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "lineitem").select(F.format_string("photo_%d_%d", "l_orderkey", "l_linenumber").alias("id"), "l_quantity")
    return catalog.by_prefix(faces, "photo_1_")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left when orders below 100 and all of order 200's lines by prefix are deleted."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.format_string("photo_%d_%d", "l_orderkey", "l_linenumber").alias("id"))
    gone = table(spark, sf_dir, "orders").filter("o_orderkey < 100").select(F.col("o_orderkey").alias("l_orderkey"))
    left = catalog.without_prefix(catalog.deleted(rows, gone, "l_orderkey"), "photo_200_")
    return left.groupBy((F.col("l_orderkey") % 10).alias("digit")).agg(F.count("*").alias("n"))


def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows replaced whole by the last event of the same number, and new ones added."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("status"), F.col("value").alias("price"))
    return catalog.upserted(old, catalog.last_of(new, "id", "event_id").select("id", "status", "price"))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the new side over those of the old, where they aren't null."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("value"))
    return catalog.merged(old, new)


def catalog_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return _shown(catalog.claimed(owned_documents(spark, sf_dir), ids, "src1"))


def catalog_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return _shown(catalog.released(owned_documents(spark, sf_dir), ids, "src1"))


def unprocessed_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (-F.col("doc_id")).alias("position"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return catalog.unprocessed(asked, (labels, F.coalesce(F.col("quality") == 1, F.lit(False))), (vectors, F.lit(True)))


def unprocessed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that lack faces, metadata, species or the cull pass, of catalog a; documents stand in for photos."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    photos = d.filter(n % 11 != 0).select(
        n.alias("id"),
        F.when(n % 5 != 0, F.lit(["a"])).otherwise(F.lit(["b"])).alias("catalogs"),
        F.lit("true").alias("has_embedding"),
        F.when(n % 3 == 0, "t").alias("title"), F.when(n % 7 == 0, "").alias("caption"), F.lit(None).cast("string").alias("alt_text"), F.when(n % 3 == 1, "k").alias("keywords"),
        F.when(n % 13 != 0, "0f").alias("cull_phash"), F.when(n % 17 != 0, F.lit("false")).alias("cull_faces_present"),
        F.when(n % 4 == 0, "true").alias("faces_checked"), F.when(n % 19 != 0, "now").otherwise("before").alias("face_model"),
        F.lit("true").alias("species_checked"), F.when(n % 23 != 0, "head").alias("species_model"),
    )
    faces = table(spark, sf_dir, "labels").select(F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("0")).alias("face_id"))
    asked = d.select(n.alias("id"), (-n).alias("position"))
    return catalog.unprocessed_photos(asked, photos, faces, faces.limit(0).select(F.lit(0).alias("id")), ["faces", "metadata", "species", "cull"], regenerate=False, owner="a", face_model="now", species_model="head")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as photos with their metadata as a map, of which some keys are missing or broken."""
    n = F.col("doc_id")
    pair = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    none = F.create_map().cast("map<string,string>")
    metadata = F.map_concat(
        pair("title", F.col("source")), pair("filename", n), pair("species_model", F.lit("head")),
        F.when(n % 2 == 0, pair("keywords", F.concat(F.lit('["'), "lang", F.lit('","k"]')))).otherwise(none),
        F.when(n % 3 == 0, F.map_concat(pair("species_checked", F.lit("true")), pair("species_rank", n % 7))).otherwise(none),
        F.when(n % 5 == 0, pair("edit_recipe", F.when(n % 2 == 0, '{"exposure":1}').otherwise("{broken"))).otherwise(none),
        F.when(n % 4 == 0, pair("edit_warnings", F.when(n % 8 == 0, '["clipped"]').otherwise("none"))).otherwise(none),
    )
    return table(spark, sf_dir, "documents").select(n.alias("id"), F.when(n % 6 != 0, F.lit(["a"])).otherwise(F.lit(["b"])).alias("catalogs"), metadata.alias("metadata"))


def photo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    d = catalog.photo_data(_described(spark, sf_dir), ids, "a")
    return d.select("id", "title", F.array_join("keywords", "|").alias("keywords"), F.col("species.rank").alias("species_rank"), F.col("species").isNotNull().alias("checked"), "edit", F.array_join("edit_warnings", "|").alias("edit_warnings"))


def metadata_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    c = catalog.cleared(_described(spark, sf_dir), ids)
    return c.select("id", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"))


def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log by user: errors delete, other events carry a vector if their value is over the middle."""
    e = table(spark, sf_dir, "events")
    log = e.select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.when(F.col("value") > 50, F.col("value")).alias("vector")
    )
    return catalog.replayed(log)


def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    eav = p.select(F.col("p_partkey").alias("id"), F.lit("size").alias("key"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("s"), F.lit(None).cast("boolean").alias("b"), F.col("p_size").alias("i"), F.lit(None).cast("double").alias("f"))
    hidden = p.select(F.col("p_partkey").alias("id"), F.lit("chroma:document").alias("key"), F.col("p_name").alias("s"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("f"))
    return catalog.pivoted(eav.unionByName(hidden))


def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_vector"))
    rows = d.join(lab, "doc_id", "left").join(v, "doc_id", "left")
    return rows.agg(
        F.count("*").alias("photos"),
        F.count_if(F.col("has_vector")).alias("with_vector"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("with_text"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"),
        F.count_distinct("source").alias("catalogs"),
        F.count_distinct(F.when(F.col("lang") != "", F.col("lang"))).alias("persons"),
    )


def persons_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    person = F.when(F.col("user_id") % 7 == 0, "").when(F.col("user_id") % 11 == 0, "person_unassigned").otherwise(F.concat(F.lit("person_"), F.col("user_id").cast("string")))
    faces = e.select(
        F.col("event_id").alias("face_id"), F.to_date("ts").alias("photo_id"), person.alias("person"), (F.col("event_type") == "signup").alias("manual"), F.round("value", 2).alias("quality"), F.when(F.col("event_type") != "error", F.col("props")).alias("thumbnail")
    )
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("person_"), F.col("c_custkey").cast("string")).alias("person"), F.col("c_name").alias("name"))
    return catalog.persons(faces, names)


def persons_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ten persons: the unassigned last, then by photos and name."""
    p = persons_rollup(spark, sf_dir)
    return p.orderBy(F.col("person") == catalog.UNASSIGNED, F.desc("photos"), "person").offset(10).limit(10).select("person", "photos", "faces")


def photos_of_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id = 5").select(F.to_date("ts").cast("string").alias("photo_id")).distinct().orderBy("photo_id")


def face_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    faces = line.select(
        F.col("l_orderkey").alias("photo_id"), (F.col("l_quantity") / 400).alias("area"), F.col("l_discount").alias("sharpness"), (1 - F.col("l_tax")).alias("visibility"), (F.col("l_extendedprice") / 100000).alias("eye"), F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("occlusion")
    )
    r = catalog.rolled_faces(faces)
    return r.select("photo_id", "face_count", *(F.round(c, 8 if c == "eye" else 6).alias(c) for c in ("sharpness", "prominence", "visibility", "eye", "occlusion")))


def training_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of time of day, focal length and tags, one row for each value."""
    e = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "value", "event_type")
    times = e.groupBy(scalar.time_of_day(F.col("hour")).alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("time"))
    focal = e.groupBy(scalar.focal_bucket(F.col("value") * 4).alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("focal"))
    tags = e.select(F.explode(F.array("event_type", F.lit("all"))).alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("kind", F.lit("tag"))
    return times.unionByName(focal).unionByName(tags).select("kind", "value", "n")


def training_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(
        F.count("*").alias("examples"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.expr("percentile(value, 0.03)"), 6).alias("p3"), F.round(F.expr("percentile(value, 0.97)"), 6).alias("p97"), (F.count("*") >= 10).alias("enough"), F.when(F.count("*") == 0, "none").when(F.count("*") < 10, "few").when(F.count("*") < 50, "some").otherwise("ready").alias("readiness")
    )


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", scalar.stable_id(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.col("c_nationkey")).alias("stable_id"))


def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.md5(scalar.eszett(F.col("text"))).alias("clean_md5"), scalar.photo_id(F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, " a "), F.col("source")).alias("photo_id"), scalar.is_raw_name(F.concat(F.col("source"), F.element_at(F.lit([".jpg", ".NEF", ".x3f", ".dcr", "nef", ".tar.RAW"]), (F.col("doc_id") % 6 + 1).cast("int")))).alias("raw")
    )


_PERSON = "CASE WHEN user_id % 7 = 0 OR user_id % 11 = 0 THEN '_unassigned' ELSE 'person_' || user_id END"
_PERSONS = f"""
WITH r AS (SELECT {_PERSON} AS person, count(*) AS faces, count(*) FILTER (event_type = 'signup') AS manual, count(DISTINCT CAST(ts AS DATE)) AS photos,
  arg_max(props, (round(value, 2), -event_id)) FILTER (event_type <> 'error') AS thumbnail FROM events GROUP BY 1)
SELECT person, c_name AS name, faces, manual, photos, thumbnail FROM r LEFT JOIN customer ON person = 'person_' || c_custkey"""

QUERIES = {
    f.__name__: f
    for f in (ids_by_flag, point_lookup, prefix_scan, delete_cascade, metadata_upsert, metadata_merge, catalog_claim, catalog_cleanup, unprocessed_delta, unprocessed_photos, photo_lookup, metadata_cleared, wal_replay, eav_pivot, db_stats, persons_rollup, persons_page, photos_of_person, face_rollup, training_stats, training_means, stable_ids, text_cleanup)
}

SQL = {
    "ids_by_flag": "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, true) AND lang = 'en'",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 32, 1000000000)",
    "prefix_scan": "SELECT 'photo_' || l_orderkey || '_' || l_linenumber AS id, l_quantity FROM lineitem WHERE l_orderkey = 1",
    "delete_cascade": "SELECT l_orderkey % 10 AS digit, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey < 100) AND l_orderkey <> 200 GROUP BY 1",
    "metadata_upsert": """
WITH new AS (SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS price FROM events GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""",
    "metadata_merge": """
WITH new AS (SELECT s_suppkey * 20 AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, s_acctbal AS value FROM supplier)
SELECT coalesce(n.id, c_custkey) AS id, coalesce(n.name, c_mktsegment) AS name, coalesce(n.value, c_acctbal) AS value FROM customer FULL JOIN new n ON n.id = c_custkey""",
    "catalog_claim": "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN array_to_string(list_sort(list_distinct([source, 'src1'])), ',') ELSE source END AS catalogs FROM documents",
    "catalog_cleanup": "SELECT doc_id AS id, CASE WHEN source = 'src1' AND doc_id NOT IN (SELECT vec_id FROM embeddings) THEN '' ELSE source END AS catalogs FROM documents",
    "unprocessed_delta": "SELECT doc_id AS id, -doc_id AS position FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings ON doc_id = vec_id WHERE coalesce(quality, 0) <> 1 OR vec_id IS NULL",
    "unprocessed_photos": """
WITH a AS (SELECT doc_id AS id, doc_id % 11 <> 0 AND doc_id % 5 <> 0 AS known FROM documents),
f AS (SELECT DISTINCT doc_id AS id FROM labels),
t AS (SELECT a.id, known, known AND id % 19 <> 0 AND (id % 4 = 0 OR f.id IS NOT NULL) AS faces, known AND id % 3 < 2 AS metadata, known AND id % 23 <> 0 AS species, known AND id % 13 <> 0 AND id % 17 <> 0 AS cull
  FROM a LEFT JOIN f USING (id))
SELECT id, -id AS position FROM t WHERE NOT (faces AND metadata AND species AND cull)""",
    "photo_lookup": """
SELECT doc_id AS id, source AS title, CASE WHEN doc_id % 2 = 0 THEN lang || '|k' END AS keywords, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 7)::VARCHAR END AS species_rank, doc_id % 3 = 0 AS checked,
  CASE WHEN doc_id % 10 = 0 THEN '{"exposure":1}' END AS edit, CASE WHEN doc_id % 8 = 0 THEN 'clipped' ELSE '' END AS edit_warnings
FROM documents WHERE doc_id % 6 <> 0 AND doc_id IN (SELECT doc_id FROM labels)""",
    "metadata_cleared": """
WITH k AS (SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS gone,
  unnest(list_filter(['filename', 'species_model', 'title', CASE WHEN doc_id % 2 = 0 THEN 'keywords' END, CASE WHEN doc_id % 3 = 0 THEN 'species_checked' END, CASE WHEN doc_id % 3 = 0 THEN 'species_rank' END,
    CASE WHEN doc_id % 5 = 0 THEN 'edit_recipe' END, CASE WHEN doc_id % 4 = 0 THEN 'edit_warnings' END], lambda x: x IS NOT NULL)) AS key FROM documents)
SELECT id, string_agg(key, ',' ORDER BY key) AS keys FROM k WHERE NOT gone OR key = 'filename' GROUP BY id""",
    "wal_replay": """
SELECT user_id AS id, CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(value, event_id) END AS vector
FROM events WHERE event_type = 'error' OR value > 50 GROUP BY 1""",
    "eav_pivot": "SELECT p_partkey AS id, 'size' AS key, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_size::VARCHAR END AS value FROM part",
    "db_stats": """
SELECT count(*) AS photos, count(vec_id) AS with_vector, count(*) FILTER (trim(coalesce(text, '')) <> '') AS with_text, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
  count(*) FILTER (quality IS NULL) AS unlabelled, count(DISTINCT source) AS catalogs, count(DISTINCT nullif(lang, '')) AS persons
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings ON doc_id = vec_id""",
    "persons_rollup": _PERSONS,
    "persons_page": f"SELECT person, photos, faces FROM ({_PERSONS}) ORDER BY person = '_unassigned', photos DESC, person LIMIT 10 OFFSET 10",
    "photos_of_person": "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS photo_id FROM events WHERE user_id = 5",
    "face_rollup": """
WITH f AS (SELECT l_orderkey AS photo_id, l_quantity / 400 AS area, l_discount AS sharpness, 1 - l_tax AS visibility, l_extendedprice / 100000 AS eye,
  CASE WHEN l_returnflag <> 'N' THEN l_tax END AS occlusion, max(l_quantity / 400) OVER (PARTITION BY l_orderkey) AS largest FROM lineitem)
SELECT photo_id, count(*) AS face_count, round(max(sharpness), 6) AS sharpness, round(max(least(1, area / 0.12)), 6) AS prominence, round(avg(visibility), 6) AS visibility,
  round(min(eye) FILTER (area >= 0.25 * largest), 8) AS eye, round(max(coalesce(occlusion, 0)) FILTER (area >= 0.25 * largest), 6) AS occlusion FROM f GROUP BY 1""",
    "training_stats": """
SELECT 'time' AS kind, CASE WHEN h BETWEEN 5 AND 7 THEN 'dawn' WHEN h BETWEEN 8 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 19 THEN 'evening' ELSE 'night' END AS value, count(*) AS n
FROM (SELECT hour(ts) AS h FROM events) GROUP BY 2
UNION ALL SELECT 'focal', CASE WHEN f <= 0 THEN 'unknown' WHEN f < 20 THEN 'ultra_wide' WHEN f < 35 THEN 'wide' WHEN f < 70 THEN 'normal' WHEN f < 135 THEN 'short_tele' WHEN f < 300 THEN 'tele' ELSE 'super_tele' END, count(*)
FROM (SELECT value * 4 AS f FROM events) GROUP BY 2
UNION ALL SELECT 'tag', v, count(*) FROM (SELECT unnest([event_type, 'all']) AS v FROM events) GROUP BY 2""",
    "training_means": """
SELECT count(*) AS examples, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.03), 6) AS p3, round(quantile_cont(value, 0.97), 6) AS p97, count(*) >= 10 AS enough,
  CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) < 10 THEN 'few' WHEN count(*) < 50 THEN 'some' ELSE 'ready' END AS readiness FROM events""",
    "stable_ids": "SELECT c_custkey, 'meta1:' || md5(c_name || '|' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '|' || c_nationkey) AS stable_id FROM customer",
    "text_cleanup": "SELECT doc_id, md5(replace(text, 'ß', 'ss')) AS clean_md5, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE source END AS photo_id, doc_id % 6 IN (1, 2, 5) AS raw FROM documents",
}

"""Registered queries of style, guardrails and taxonomy, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import scalar
from lumenlake.functions.vector import cosine_or_one
from lumenlake.operators import style, taxonomy
from lumenlake.plans.search import photos, table, vector_of


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as training rows, with settings and features from parts of the same number; vector 2 is the query."""
    p = photos(spark, sf_dir)
    pool = p.filter("id <> 2").select("id", cosine_or_one(F.col("vector"), F.lit(vector_of(p, 2))).alias("d")).orderBy("d", "id").limit(style.POOL)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice", "p_type", "p_brand")
    tags = F.split("p_type", " ")
    rows = pool.join(part, "id").select(
        "id",
        "p_size",
        "p_retailprice",
        style.composite(
            style.clip_similarity(F.col("d")),
            scalar.exposure_proximity([(F.lit(0.5), F.col("p_size") / 50), (F.lit(0.4), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") / 2000))]),
            scalar.jaccard_tags(F.lit(["PROMO", "TIN"]), tags),
            scalar.time_proximity(F.lit("morning"), scalar.time_of_day(F.col("p_size") % 24)),
        ).alias("score"),
    )
    return rows.orderBy(F.desc("score"), "id")


def style_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


def style_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the three best; size is missing where it is odd."""
    best = _scored(spark, sf_dir).limit(style.WINNERS)
    settings = F.map_filter(F.create_map(F.lit("contrast"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")), F.lit("exposure"), F.col("p_retailprice") / 100), lambda k, v: v.isNotNull())
    return style.blended(best.withColumn("settings", settings).withColumn("request", F.lit(1)), "score", "settings", ["request"]).select("key", "value")


def edit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    parts = style.budget(F.col("l_discount") * 8, F.col("l_quantity") / 6, F.col("l_tax") / 3, F.col("l_discount") / 6, F.col("l_tax") * 4, F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") / 8))
    out = line.select("l_orderkey", "l_linenumber", *parts)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 7).alias(c) for c in ("contrast", "clarity", "shadows", "whites")), F.array_join("reasons", ",").alias("reasons"))


def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves from quantity, discount and tax scaled to a budget of 25."""
    line = table(spark, sf_dir, "lineitem")
    moves = F.array(F.col("l_quantity") - 20, F.col("l_discount") * 100, F.col("l_tax") * 100 - 5)
    fit = line.select("l_orderkey", "l_linenumber", style.fitted(moves, F.lit(25.0)).alias("m"))
    return fit.select("l_orderkey", "l_linenumber", *(F.round(F.get("m", i), 4).alias(n) for i, n in enumerate(("contrast", "clarity", "dehaze"))))


def recipe_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    settings = F.create_map(F.lit("contrast"), F.col("l_quantity") * 5 - 60, F.lit("exposure"), F.col("l_discount") * 100 - 5, F.lit("sharpening"), F.col("l_tax") * 3000 - 20, F.lit("unknown"), F.lit(1.0))
    held = line.select("l_orderkey", "l_linenumber", style.in_range(settings).alias("s"))
    return held.select("l_orderkey", "l_linenumber", F.size("s").alias("n"), *(F.round(F.col("s")[k], 4).alias(k) for k in ("contrast", "exposure", "sharpening")))


def compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    light, tones = F.col("p_size") / 50, F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") / 2000)
    return p.select("p_partkey", style.compensation(light, F.lit(0.45), 5, 1.5, 0.05, 2).alias("exposure"), style.compensation(tones, F.lit(0.5), 20, 15.0, 1.0, 1).alias("contrast"))


def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("class"), F.col("n_name").alias("genus"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 1000).alias("logit")
    )


RANKS = ["class", "genus", "name"]


def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = taxonomy.probabilities(_species(spark, sf_dir), [], "logit")
    return taxonomy.rolled_up(p, RANKS).select("depth", "class", "genus", "name", F.round("p", 6).alias("p"))


def taxonomy_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = taxonomy.rolled_up(taxonomy.probabilities(_species(spark, sf_dir), [], "logit"), RANKS)
    return taxonomy.answer(rolled, RANKS, 0.15).select("depth", "class", "genus", "name", F.round("p", 6).alias("p"))


def taxa_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _species(spark, sf_dir).select(F.col("name").alias("id"), "class", "genus", F.when(F.col("logit") > 5, F.col("name")).alias("name"))
    return taxonomy.pruned(s, ["EUROPE", "ASIA"]).select("id", "class", "genus")


def url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", scalar.search_url("https://example.org/search?q=", F.lower("n_name"), F.lit("map & flag")).alias("url"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, minutes and seconds from quantities, to the south where the flag is R; hues wrapped."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        "l_orderkey",
        "l_linenumber",
        scalar.degrees(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount") * 100, F.when(F.col("l_returnflag") == "R", "S").otherwise("N")).alias("latitude"),
        F.round(scalar.wrapped(F.col("l_quantity") * 20 - 300, -180.0, 180.0), 4).alias("hue"),
    )


_STYLE = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 2),
pool AS (SELECT vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS d FROM embeddings, q WHERE vec_id <> 2 ORDER BY d, id LIMIT 20),
f AS (SELECT id, d, p_size, p_retailprice, string_split(p_type, ' ') AS tags, p_size % 24 AS h,
  CASE WHEN p_size % 2 = 0 THEN (abs(0.5 - p_size / 50) + abs(0.4 - p_retailprice / 2000)) / 2 ELSE abs(0.5 - p_size / 50) END AS delta FROM pool JOIN part ON p_partkey = id),
g AS (SELECT *, CASE WHEN h BETWEEN 5 AND 7 THEN 1 WHEN h BETWEEN 8 AND 11 THEN 2 WHEN h BETWEEN 12 AND 16 THEN 3 WHEN h BETWEEN 17 AND 19 THEN 4 ELSE 5 END AS t FROM f),
s AS (SELECT id, p_size, p_retailprice, 0.5 * least(1, greatest(0, 1 - d)) + 0.25 * greatest(0, 1 - delta / 0.3)
  + 0.15 * len(list_intersect(['PROMO', 'TIN'], tags)) / len(list_distinct(list_concat(['PROMO', 'TIN'], tags)))
  + 0.10 * greatest(0, 1 - 0.35 * least(abs(2 - t), 5 - abs(2 - t))) AS score FROM g)"""
_SPECIES = "s AS (SELECT r_name AS class, n_name AS genus, c_name AS name, c_acctbal / 1000 AS logit FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_P = f"{_SPECIES}, p AS (SELECT *, exp(logit - (SELECT max(logit) FROM s)) / (SELECT sum(exp(logit - (SELECT max(logit) FROM s))) FROM s) AS p FROM s)"


def _away(x: str, digits: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * {10.0**digits} + 0.5) / {10.0**digits})"


_FIT = "CASE WHEN spend > 25 THEN greatest(0, least(1, 25 / spend)) ELSE 1 END"

QUERIES = {
    f.__name__: f for f in (style_score, style_blend, edit_budget, budget_fit, recipe_clamp, compensation, taxonomy_rollup, taxonomy_answer, taxa_pruning, url_links, coordinates)
}

SQL = {
    "style_score": f"WITH {_STYLE} SELECT id, round(score, 6) AS score FROM s",
    "style_blend": f"""WITH {_STYLE}, w AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 3), t AS (SELECT sum(score) AS total FROM w),
b AS (SELECT 'exposure' AS key, sum(score / total * p_retailprice / 100) AS x FROM w, t UNION ALL SELECT 'contrast', sum(score / total * p_size) FILTER (p_size % 2 = 0) FROM w, t)
SELECT key, {_away("x", 1)} AS value FROM b WHERE x IS NOT NULL""",
    "edit_budget": """
WITH f AS (SELECT l_orderkey, l_linenumber, l_discount * 8 AS hard, l_quantity / 6 AS stops, l_tax / 3 AS spec, l_discount / 6 AS hi, l_tax * 4 AS sh, l_returnflag = 'N' AS raw,
  CASE WHEN l_linestatus = 'O' THEN least(1, greatest(0, (l_extendedprice / 8 - 400) / 6000)) ELSE 0 END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN hard >= 0.55 OR stops >= 6.5 THEN 0 WHEN stops <= 3.5 THEN 40 ELSE 25 END::DOUBLE, 7) AS contrast,
  round(least(CASE WHEN hard >= 0.55 THEN 0 ELSE 20 END, CASE WHEN x > 0 THEN 20 * (1 - 0.5 * x) ELSE 20 END)::DOUBLE, 7) AS clarity,
  round(CASE WHEN sh >= 0.25 THEN least(60 * (1 - 0.75 * x), 15) ELSE 60 * (1 - 0.75 * x) END::DOUBLE, 7) AS shadows,
  round(CASE WHEN (spec >= 0.02 OR hi >= 0.02) AND raw THEN 12.5 WHEN spec >= 0.02 OR hi >= 0.02 THEN 0 ELSE 25 END::DOUBLE, 7) AS whites,
  array_to_string(list_filter([CASE WHEN hard >= 0.55 THEN 'hard_light_no_added_contrast' END, CASE WHEN hard < 0.55 AND stops >= 6.5 THEN 'no_tonal_headroom' END,
    CASE WHEN hard < 0.55 AND stops <= 3.5 THEN 'flat_light_contrast_allowed' END, CASE WHEN (spec >= 0.02 OR hi >= 0.02) AND NOT raw THEN 'highlights_unrecoverable' END,
    CASE WHEN x > 0.5 THEN 'high_iso_shadows_limited' END, CASE WHEN sh >= 0.25 THEN 'shadows_already_clipped' END], lambda y: y IS NOT NULL), ',') AS reasons FROM f""",
    "budget_fit": f"""
WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity - 20 AS a, l_discount * 100 AS b, l_tax * 100 - 5 AS c FROM lineitem), s AS (SELECT *, greatest(a, 0) + greatest(b, 0) + greatest(c, 0) AS spend FROM m)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a > 0 THEN a * {_FIT} ELSE a END, 4) AS contrast, round(CASE WHEN b > 0 THEN b * {_FIT} ELSE b END, 4) AS clarity, round(CASE WHEN c > 0 THEN c * {_FIT} ELSE c END, 4) AS dehaze FROM s""",
    "recipe_clamp": """
SELECT l_orderkey, l_linenumber, 3::INTEGER AS n, round(greatest(-100, least(100, l_quantity * 5 - 60)), 4) AS contrast, round(greatest(-5, least(5, l_discount * 100 - 5)), 4) AS exposure, round(greatest(0, least(150, l_tax * 3000 - 20)), 4) AS sharpening FROM lineitem""",
    "compensation": f"""
WITH m AS (SELECT p_partkey, greatest(-1.5, least(1.5, -5 * (p_size / 50 - 0.45))) AS a, greatest(-15, least(15, -20 * (coalesce(CASE WHEN p_size % 3 <> 0 THEN p_retailprice / 2000 END, 0.5) - 0.5))) AS b FROM part)
SELECT p_partkey, CASE WHEN abs(a) > 0.05 THEN {_away("a", 2)} ELSE 0 END::DOUBLE AS exposure, CASE WHEN abs(b) > 1 THEN {_away("b", 1)} ELSE 0 END::DOUBLE AS contrast FROM m""",
    "taxonomy_rollup": f"WITH {_P} SELECT 1::INTEGER AS depth, class, NULL AS genus, NULL AS name, round(sum(p), 6) AS p FROM p GROUP BY class UNION ALL SELECT 2, class, genus, NULL, round(sum(p), 6) FROM p GROUP BY class, genus UNION ALL SELECT 3, class, genus, name, round(sum(p), 6) FROM p GROUP BY class, genus, name",
    "taxonomy_answer": f"""WITH {_P}, a AS (SELECT 1::INTEGER AS depth, class, NULL AS genus, NULL AS name, sum(p) AS p FROM p GROUP BY class UNION ALL SELECT 2, class, genus, NULL, sum(p) FROM p GROUP BY class, genus UNION ALL SELECT 3, class, genus, name, sum(p) FROM p GROUP BY class, genus, name),
b AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY p DESC) AS k FROM a) SELECT depth, class, genus, name, round(p, 6) AS p FROM b WHERE k = 1 AND p >= 0.15 ORDER BY depth DESC LIMIT 1""",
    "taxa_pruning": f"""WITH {_SPECIES}, t AS (SELECT name AS id, class, genus, CASE WHEN logit > 5 THEN name END AS name FROM s), k AS (SELECT * FROM t WHERE class IN ('EUROPE', 'ASIA') AND name IS NOT NULL)
SELECT id, class, genus FROM k UNION ALL SELECT min(id), any_value(class), genus FROM t WHERE genus NOT IN (SELECT genus FROM k) GROUP BY genus""",
    "url_links": "SELECT n_nationkey, 'https://example.org/search?q=' || replace(replace(lower(n_name), ' ', '+'), '%20', '+') || '+map+%26+flag' AS url FROM nation",
    "coordinates": f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * {_away("(l_quantity + l_linenumber / 60 + l_discount * 100 / 3600)", 6)} AS latitude,
  round(-180 + (((l_quantity * 20 - 120) % 360) + 360) % 360, 4) AS hue FROM lineitem""",
}

"""Registered queries of style results, recipes, histograms and the species gate, with SQL. Suppliers stand in for
requests, lines of orders for training examples that were retrieved for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import histogram
from lumenlake.operators import recipes, style, taxonomy
from lumenlake.plans.search import table


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of orders, each with at most seven; scores are never equal within one."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request"),
        F.col("l_linenumber").alias("id"),
        (F.col("l_quantity") / 60 + F.col("l_linenumber") / 1000).alias("score"),
        F.when(F.col("l_linenumber") != 2, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("name"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag") == "A").alias("raw"),
        F.when(F.col("l_orderkey") % 3 > 0, F.col("l_orderkey") % 3 == 1).alias("query_raw"),
        F.map_filter(F.create_map(F.lit("temperature"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") * 100)), lambda k, v: v.isNotNull()).alias("settings"),
    )


def style_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"))
    out = style.outcome(_examples(spark, sf_dir), requests, 100)
    return out.select("request", "engine", "confidence", "matched", F.array_join("names", ",").alias("names"), "warning")


def style_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.restricted_temperature(_examples(spark, sf_dir), ["request"])


def recent_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("string")).alias("captured_at"))
    return style.recent(rows).select("id", "captured_at", "distance")


def recipe_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures of raw and other files, and settings that a control takes away."""
    line = table(spark, sf_dir, "lineitem")
    settings = F.create_map(F.lit("temperature"), F.col("l_quantity") * 20 - 200, F.lit("grain_size"), F.col("l_quantity") * 3, F.lit("tint"), F.col("l_quantity") * 5 - 10)
    held = style.in_range(settings, F.when(F.col("l_returnflag") != "R", F.col("l_returnflag") == "A"))
    kept = style.controlled(held, F.create_map(F.lit("adjust_effects"), F.col("l_linestatus") == "O"))
    return line.select("l_orderkey", "l_linenumber", kept.alias("s")).select("l_orderkey", "l_linenumber", *(F.try_element_at("s", F.lit(k)).cast("double").alias(k) for k in ("temperature", "grain_size", "tint")))


def recipe_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    n, q, d = F.col("l_linenumber"), F.col("l_quantity") / 50, F.col("l_discount") * 10
    edges = F.when(n % 3 == 0, F.create_map(F.lit("left"), d, F.lit("right"), q, F.lit("top"), F.lit(0.25)))
    box = F.create_map(F.lit("x"), d / 2, F.lit("y"), q / 4, F.lit("width"), q, F.lit("height"), F.lit(0.5), F.lit("rotation"), q * 100)
    crop, reasons = style.cropped(F.coalesce(edges, box))
    return line.select("l_orderkey", "l_linenumber", crop.alias("c"), F.array_join(reasons, ",").alias("reasons")).select(
        "l_orderkey", "l_linenumber", *(F.try_element_at("c", F.lit(k)).alias(f"edge_{k}") for k in ("left", "right", "top", "bottom")), F.try_element_at("c", F.lit("angle")).alias("angle"), "reasons"
    )


def recipe_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as recipes in JSON: numbers as texts, curves in two shapes, unknown channels, masks that fit and that don't."""
    line = table(spark, sf_dir, "lineitem")
    text = F.format_string(
        '{"summary":" %s ","global":{"exposure":"%s","whites":%s,"tone_curve":{"lights":%s,"point_curve":{"red":%s}},"hsl":{"red":{"hue":%s},"pink":{"hue":1}},"color_grading":{"shadows":{"hue":%s},"balance":%s}},"masks":[{"kind":"%s","adjustments":{"dehaze":%s}}]}',
        "l_returnflag", *(F.col(c).cast("long").cast("string") for c in ("l_linenumber", "l_quantity")), (F.col("l_quantity").cast("long") * 4).cast("string"),
        F.when(F.col("l_linenumber") % 2 == 0, F.format_string("[[0,%d],[300,9]]", F.col("l_quantity").cast("long"))).otherwise(F.format_string("[0,%d,300]", F.col("l_quantity").cast("long"))),
        *((F.col("l_quantity").cast("long") * k).cast("string") for k in (3, 8, -3)),
        F.when(F.col("l_returnflag") == "A", "Sky").when(F.col("l_returnflag") == "R", "moon").otherwise("subject"), F.when(F.col("l_linestatus") == "F", "150").otherwise("null"),
    )
    n = recipes.normalized_once(line.select("l_orderkey", "l_linenumber", text.alias("recipe"))).withColumnRenamed("normalized", "n")
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return n.select(
        "l_orderkey", "l_linenumber", "n.summary", at("n.settings", "exposure").alias("exposure"), at("n.settings", "whites").alias("whites"), at("n.tones", "lights").alias("lights"),
        F.array_join(at("n.curves", "red").cast("array<string>"), ",").alias("red"), at(at("n.hsl", "red"), "hue").alias("hue"), F.size("n.hsl").cast("long").alias("channels"),
        at(at("n.grading", "shadows"), "hue").alias("shade"), at("n.grading_levels", "balance").alias("balance"), F.array_join("n.masks.kind", ",").alias("masks"), F.array_join("n.warnings", "|").alias("warnings"),
    )


def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of event values by kind: where shares of them end, and how much is clipped."""
    bins = histogram.binned(table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("v")), "event_type", "v")
    marks = histogram.percentiles(bins, "event_type", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return marks.join(histogram.share_from(bins, "event_type", 0.1, 0.9), "event_type").select("event_type", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p95", "below", "above")))


def top_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the largest tenth of each vector's numbers."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(histogram.top_mean(F.transform("embedding", lambda x: x.cast("double")), 0.1), 6).alias("top"))


def species_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(taxonomy.worth_asking(F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 50)).alias("ask")).agg(F.count("*").alias("n"))


_EXAMPLES = """
e AS (SELECT l_orderkey AS request, l_linenumber AS id, l_quantity / 60 + l_linenumber / 1000 AS score, CASE WHEN l_linenumber <> 2 THEN 'f' || l_linenumber END AS name,
  coalesce(CASE WHEN l_returnflag <> 'R' THEN l_returnflag = 'A' END = CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 3 = 1 END, true) AS fits,
  CASE WHEN l_linenumber % 3 > 0 THEN l_quantity * 100 END AS t FROM lineitem)"""


def _away(x: str, digits: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * {10**digits}::DOUBLE + 0.5) / {10**digits}::DOUBLE)"


def _unit(x: str) -> str:
    return _away(f"greatest(0, least(1, ({x})::DOUBLE))", 4)


QUERIES = {f.__name__: f for f in (style_outcome, style_temperature, recent_examples, recipe_temperature, recipe_crop, recipe_parts, brightness, top_tenth, species_gate)}

SQL = {
    "style_outcome": f"""WITH {_EXAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS k FROM e),
w AS (SELECT request, {_away("max(score)", 3)} AS best, count(*)::INTEGER AS n, string_agg(coalesce(name, id::VARCHAR), ',' ORDER BY k) AS names FROM r WHERE k <= 3 GROUP BY request)
SELECT o_orderkey AS request, CASE WHEN n IS NULL THEN 'none' ELSE 'style' END AS engine, coalesce(best, 0) AS confidence, coalesce(n, 0) AS matched, coalesce(names, '') AS names,
  CASE WHEN n IS NULL THEN 'nothing_found' WHEN best < 0.45 THEN 'low_confidence' WHEN best < 0.7 THEN 'moderate_confidence' END AS warning FROM orders LEFT JOIN w ON o_orderkey = request""",
    "style_temperature": f"""WITH {_EXAMPLES}, a AS (SELECT request, count(t) > 0 AS has, sum(score) FILTER (fits) AS weight, coalesce(sum(score * t) FILTER (fits), 0) AS total, count(*) FILTER (fits) AS matching, count(*) AS winners FROM e GROUP BY request)
SELECT request, CASE WHEN has AND weight > 0 THEN {_away("(total / weight)", 1)} END AS temperature, matching, winners FROM a""",
    "recent_examples": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::VARCHAR END AS captured_at, 0.5::DOUBLE AS distance FROM orders
ORDER BY coalesce(captured_at, '') DESC, id LIMIT 20""",
    "recipe_temperature": """WITH t AS (SELECT *, l_quantity * 20 - 200 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN greatest(2000, least(50000, t)) WHEN abs(t) > 500 THEN NULL ELSE greatest(-100, least(100, t)) END::DOUBLE AS temperature,
  CASE WHEN l_linestatus = 'O' THEN least(100, l_quantity * 3) END::DOUBLE AS grain_size, least(150, l_quantity * 5 - 10)::DOUBLE AS tint FROM t""",
    "recipe_crop": f"""WITH q AS (SELECT *, l_quantity / 50 AS q, l_discount * 10 AS d FROM lineitem),
x AS (SELECT *, {_unit("d / 2")} AS x, {_unit("q / 4")} AS y, {_unit("q")} AS w, 0.5::DOUBLE AS h FROM q),
e AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 AS own, CASE WHEN l_linenumber % 3 = 0 THEN {_unit("d")} ELSE x END AS l,
  CASE WHEN l_linenumber % 3 = 0 THEN {_unit("q")} ELSE least(1, {_away("(x + w)", 4)}) END AS r, y AS t, least(1, {_away("(y + h)", 4)}) AS b, {_away("greatest(-45, least(45, (q * 100)::DOUBLE))", 4)} AS a FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN l < r THEN l END AS edge_left, CASE WHEN l < r THEN r END AS edge_right, CASE WHEN NOT own AND t < b THEN t END AS edge_top, CASE WHEN NOT own AND t < b THEN b END AS edge_bottom,
  CASE WHEN NOT own THEN a END AS angle, CASE WHEN l < r THEN '' ELSE 'left_not_before_right' END AS reasons FROM e""",
    "recipe_parts": """WITH q AS (SELECT *, l_quantity::BIGINT AS q, CASE l_returnflag WHEN 'A' THEN 'sky' WHEN 'R' THEN 'moon' ELSE 'subject' END AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag AS summary, least(5, l_linenumber)::DOUBLE AS exposure, q::DOUBLE AS whites, least(100, q * 4)::DOUBLE AS lights,
  CASE WHEN l_linenumber % 2 = 0 THEN '0,' || q || ',255,9' END AS red, least(100, q * 3)::DOUBLE AS hue, 1::BIGINT AS channels, least(360, q * 8)::DOUBLE AS shade, greatest(-100, q * -3)::DOUBLE AS balance,
  CASE WHEN kind <> 'moon' AND l_linestatus = 'F' THEN kind ELSE '' END AS masks,
  CASE WHEN kind = 'moon' THEN 'Ignored mask #1: unsupported kind ''moon''.' WHEN l_linestatus <> 'F' THEN 'Ignored mask ''' || kind || ''': no supported adjustments were returned.' ELSE '' END AS warnings FROM q""",
    "brightness": f"""WITH b AS (SELECT event_type, {_away("(greatest(0, least(255, value / 100 * 255)))", 0)}::INTEGER AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b)
SELECT event_type, round(min(bin) FILTER (upto >= 0.05::DOUBLE * total) / 255, 6) AS p05, round(min(bin) FILTER (upto >= 0.5::DOUBLE * total) / 255, 6) AS p50, round(min(bin) FILTER (upto >= 0.95::DOUBLE * total) / 255, 6) AS p95,
  round((coalesce(sum(n) FILTER (bin <= 25), 0) / any_value(total))::DOUBLE, 6) AS below, round((coalesce(sum(n) FILTER (bin >= 230), 0) / any_value(total))::DOUBLE, 6) AS above FROM c GROUP BY event_type""",
    "top_tenth": """WITH s AS (SELECT vec_id, list_reverse_sort(embedding::DOUBLE[]) AS v, greatest(1, least(len(embedding), floor(len(embedding) * 0.1::DOUBLE + 0.5)))::BIGINT AS k FROM embeddings)
SELECT vec_id, round(list_sum(v[1:k]) / k, 6) AS top FROM s""",
    "species_gate": "SELECT l_linenumber = 1 OR l_quantity / 50 >= 0.35 AS ask, count(*) AS n FROM lineitem GROUP BY 1",
}

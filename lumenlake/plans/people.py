"""Registered queries of people edited by hand, with SQL. Lines of orders stand in for faces, orders for photos, suppliers
for persons; carrying over has no SQL and is tested against a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import people
from lumenlake.plans.search import photos, table


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.format_string("photo_%d_%d", "l_orderkey", "l_linenumber").alias("face_id"),
        F.when(n % 7 == 0, "person_unassigned").otherwise(F.concat(F.lit("person_"), n.cast("string"))).alias("person"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("manual"),
        F.when(F.col("l_tax") > 0, F.col("l_discount") * 10).alias("distance"),
        people.quality(F.col("l_quantity") / 50, F.col("l_discount"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")), F.col("l_quantity") / 200).alias("quality"),
    )


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("person_"), F.col("c_custkey").cast("string")).alias("person"), F.col("c_name").alias("name"))


def _counted(faces: DataFrame, names: DataFrame) -> DataFrame:
    counts = faces.groupBy("person").agg(F.count("*").alias("faces"), F.count_if(F.coalesce("manual", F.lit(False))).alias("manual"))
    return counts.join(names, "person", "left").select("person", "name", "faces", "manual")


def face_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty faces of one person, in each of the three orders."""
    own = _faces(spark, sf_dir).filter("person = 'person_3'")
    pages = [people.page(own, o, 20, 20).select(F.lit(o).alias("sorted"), "face_id") for o in ("typical", "outlier", "quality")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def person_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first faces of all orders below 500 become a new person."""
    faces, names = _faces(spark, sf_dir), _names(spark, sf_dir)
    ids = table(spark, sf_dir, "orders").filter("o_orderkey < 500").select(F.format_string("photo_%d_1", "o_orderkey").alias("face_id"))
    return _counted(people.assigned(faces, ids, people.next_person(faces, names)), names)


def person_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons 1 to 3 become one, which keeps a name that any of them had."""
    merged = people.merged_persons(_faces(spark, sf_dir), _names(spark, sf_dir), ["person_1", " person_2", "person_3", "_unassigned"])
    return _counted(*merged)


def person_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(*people.named(_faces(spark, sf_dir), _names(spark, sf_dir), "person_4", " Anna "))


def faces_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourth faces of orders that have fewer."""
    ids = table(spark, sf_dir, "orders").select(F.format_string("photo_%d_4", "o_orderkey").alias("face_id"))
    return people.missing(_faces(spark, sf_dir), ids)


def face_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as faces, sixteen to a photo: the odd ones are old, and found again in the even ones where they are near."""
    p, n = photos(spark, sf_dir), F.col("id")
    photo = F.floor(n / 16).alias("photo_id")
    old = p.filter(n % 2 == 1).select(
        photo, n.cast("string").alias("face_id"), "vector", F.when(n % 5 != 0, F.concat(F.lit("person_"), F.col("label").cast("string"))).alias("person"), (n % 10 == 5).alias("manual"), F.when(n % 7 != 0, "now").otherwise("before").alias("model")
    )
    found = p.filter(n % 2 == 0).select(photo, n.alias("at"), "vector")
    return people.carried_over(found, old, "now", 0.8).select("photo_id", "at", "person", "manual")


_FACES = """
faces AS (SELECT 'photo_' || l_orderkey || '_' || l_linenumber AS face_id, CASE WHEN l_suppkey % 7 = 0 THEN 'person_unassigned' ELSE 'person_' || l_suppkey END AS person,
  coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END, false) AS manual, CASE WHEN l_tax > 0 THEN l_discount * 10 END AS distance,
  0.4::DOUBLE * (l_quantity / 50) + 0.3::DOUBLE * l_discount + 0.2::DOUBLE * (1 - CASE WHEN l_tax > 0.02 THEN l_tax ELSE 0 END) + 0.1::DOUBLE * least(1, greatest(0, l_quantity / 200 / 0.12::DOUBLE)) AS quality FROM lineitem),
names AS (SELECT 'person_' || c_custkey AS person, c_name AS name FROM customer WHERE c_custkey % 3 = 0)"""
_COUNTED = "SELECT person, any_value(name) AS name, count(*) AS faces, count(*) FILTER (manual) AS manual FROM {} GROUP BY person"


def _page(name: str, order: str) -> str:
    return f"(SELECT '{name}' AS sorted, face_id FROM faces WHERE person = 'person_3' ORDER BY {order}, face_id LIMIT 20 OFFSET 20)"


QUERIES = {f.__name__: f for f in (face_pages, person_assign, person_merge, person_name, faces_missing, face_carry_over)}

SQL = {
    "face_pages": f"""WITH {_FACES} {_page("typical", "distance ASC NULLS LAST, quality DESC")} UNION ALL {_page("outlier", "distance DESC NULLS LAST, quality")}
UNION ALL {_page("quality", "quality DESC")}""",
    "person_assign": f"""WITH {_FACES}, used AS (SELECT l_suppkey AS n FROM lineitem WHERE l_suppkey % 7 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0),
ids AS (SELECT 'photo_' || o_orderkey || '_1' AS face_id FROM orders WHERE o_orderkey < 500),
moved AS (SELECT CASE WHEN face_id IN (FROM ids) THEN 'person_' || (SELECT max(n) + 1 FROM used) ELSE person END AS person, manual OR face_id IN (FROM ids) AS manual FROM faces)
{_COUNTED.format("moved LEFT JOIN names USING (person)")}""",
    "person_merge": f"""WITH {_FACES}, best AS (SELECT person FROM faces WHERE person IN ('person_1', 'person_2', 'person_3') GROUP BY person ORDER BY count(*) DESC, person LIMIT 1),
moved AS (SELECT CASE WHEN person IN ('person_1', 'person_2', 'person_3') THEN (FROM best) ELSE person END AS person, manual OR person IN ('person_1', 'person_2', 'person_3') AS manual FROM faces),
called AS (SELECT * FROM names WHERE person NOT IN ('person_1', 'person_2', 'person_3')
  UNION ALL (SELECT (FROM best), name FROM names WHERE person IN ('person_1', 'person_2', 'person_3') ORDER BY person = (FROM best) DESC, person LIMIT 1))
{_COUNTED.format("moved LEFT JOIN called USING (person)")}""",
    "person_name": f"""WITH {_FACES}, called AS (SELECT * FROM names WHERE person <> 'person_4' UNION ALL SELECT 'person_4', 'Anna'),
fixed AS (SELECT person, manual OR person = 'person_4' AS manual FROM faces) {_COUNTED.format("fixed LEFT JOIN called USING (person)")}""",
    "faces_missing": "SELECT 'photo_' || o_orderkey || '_4' AS face_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)",
}

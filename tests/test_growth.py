"""Fixtures and recipes of tables that grow: no text holds a share of the table, and equal recipes are read once."""

from pyspark.sql import functions as F

from lumenlake.operators import recipes
from lumenlake.plans import loads
from lumenlake.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_no_text_of_a_fixture_grows_with_the_table(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    most = events.groupBy("user_id").count().agg(F.max("count")).first()[0]
    texts = loads._texts(spark, SF)
    photos, broken = fixtures.parsed(texts)
    assert texts.agg(F.max(F.size(F.split("text", "capture_time")))).first()[0] == most + 1
    assert photos.count() == events.count() and broken.isEmpty()
    split = photos.groupBy("fixture", "group_id").agg(F.count("*").alias("n"), F.max("at").alias("last")).filter("n <> last + 1")
    assert split.isEmpty()


def test_equal_recipes_are_read_once(spark, monkeypatch):
    texts = ['{"global":{"exposure":1}}', '{"global":{"temperature":9000}}', "junk", "", None]
    rows = spark.createDataFrame([(i, texts[i % 5], (None, True, False)[i % 3]) for i in range(300)], "id long, recipe string, raw boolean")
    whole, seen = recipes.normalized, []
    monkeypatch.setattr(recipes, "normalized", lambda some, *more: seen.append(some.count()) or whole(some, *more))
    plain = {r.id: r.asDict(True) for r in whole(rows, "recipe", "raw").collect()}
    assert {r.id: r.asDict(True) for r in recipes.normalized_once(rows, raw="raw").collect()} == plain and seen == [15]
    monkeypatch.setattr(recipes, "FEW", 10)
    assert {r.id: r.asDict(True) for r in recipes.normalized_once(rows, raw="raw").collect()} == plain and seen == [15, 300]
    assert {r.id: r.normalized for r in recipes.normalized_once(rows.drop("raw")).collect()} == {r.id: r.normalized for r in whole(rows.drop("raw")).collect()}

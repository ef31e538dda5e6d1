"""Edits of people, faces found anew, and small cases of settings and histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import histogram
from lumenlake.operators import keywords, ordering, people, style, taxonomy
from lumenlake.plans import people as plans

SF = "/root/testdata/sf0.001"
FACES = "face_id string, person string, manual boolean"
NAMES = "person string, name string"


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_carry_over_against_a_loop(spark):
    vectors = {r.vec_id: (np.array(r.embedding, dtype=float), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = set()
    for photo in {i // 16 for i in vectors}:
        pairs = []
        for i in (i for i in vectors if i // 16 == photo and i % 2 == 0):
            for j in (j for j in vectors if j // 16 == photo and j % 2 == 1 and j % 7 != 0 and (j % 5 != 0 or j % 10 == 5)):
                a, b = vectors[i][0], vectors[j][0]
                distance = 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
                if distance <= 0.8:
                    pairs.append((distance, i, j))
        new, old = {}, set()
        for _, i, j in sorted(pairs):
            if i not in new and j not in old:
                new[i] = ("" if j % 5 == 0 else f"person_{vectors[j][1]}", j % 10 == 5)
                old.add(j)
        want |= {(photo, i, *new.get(i, ("", False))) for i in vectors if i // 16 == photo and i % 2 == 0}
    got = rows(plans.face_carry_over(spark, SF), "photo_id", "at", "person", "manual")
    assert got == want and any(p for _, _, p, _ in got)


def test_redetected(spark):
    old = spark.createDataFrame(
        [("p", "p_0", [1.0, 0.0], "person_1", False, "now"), ("p", "p_1", [0.0, 1.0], "person_2", True, "before"), ("q", "q_0", [1.0, 0.0], "person_1", False, "now"), ("r", "r_0", [1.0, 0.0], "", True, "now")],
        "photo_id string, face_id string, vector array<double>, person string, manual boolean, model string",
    )
    photos = spark.createDataFrame([("p",), ("q",), ("p",)], "photo_id string")
    found = spark.createDataFrame([("p", 0, [0.0, 1.0]), ("p", 1, [1.0, 0.01]), ("p", 2, [1.0, 0.02])], "photo_id string, at int, vector array<double>")
    got = rows(people.redetected(old, photos, found, "now"), "face_id", "person", "manual", "model")
    assert got == {("p_0", "", False, "now"), ("p_1", "person_1", False, "now"), ("p_2", "", False, "now"), ("r_0", "", True, "now")}
    assert people.carried_over(found.limit(0), old, "now").count() == 0


def test_edits_of_people(spark):
    faces = spark.createDataFrame([("a", "person_2", False), ("b", "person_10", None), ("c", None, False), ("d", "person_2", False), ("e", "person_10", False)], FACES)
    names = spark.createDataFrame([("person_12", "x"), ("person_10", "Bo"), ("other", "y")], NAMES)
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "face_id string")
    assert people.next_person(faces, names) == "person_13" and people.next_person(faces.limit(0), names.limit(0)) == "person_0"
    assert rows(people.assigned(faces, ids, "_unassigned"), *faces.columns) == {("a", "person_unassigned", True), ("b", "person_10", False), ("c", None, False), ("d", "person_2", False), ("e", "person_10", False)}
    assert rows(people.missing(faces, ids), "face_id") == {("z",)}
    after, called = people.merged_persons(faces, names, ["person_10", "person_2", ""])
    assert rows(after, *faces.columns) == {("c", None, False), *((f, "person_10", True) for f in "abde")}
    assert rows(called, "person", "name") == {("person_12", "x"), ("person_10", "Bo"), ("other", "y")}
    into, called = people.merged_persons(faces, names, ["person_10", "person_2"], into="person_2")
    assert rows(called, "person", "name") == {("person_12", "x"), ("person_2", "Bo"), ("other", "y")} and rows(into, "person") == {("person_2",), (None,)}
    assert ("person_10", "Cy") in rows(people.merged_persons(faces, names, ["person_10", "person_2"], name=" Cy ")[1], "person", "name")
    with pytest.raises(ValueError):
        people.merged_persons(faces, names, ["person_2", "person_2", "_unassigned"])
    kept, called = people.named(faces, names, "person_10", "  ")
    assert rows(kept, *faces.columns) == rows(faces, *faces.columns) and rows(called, "person", "name") == {("person_12", "x"), ("other", "y")}


def test_small_cases(spark):
    none = F.lit(None).cast("double")
    crop, reasons = style.cropped(F.create_map(F.lit("top"), F.lit(0.6), F.lit("bottom"), F.lit(0.2), F.lit("left"), F.lit(0.1), F.lit("angle"), F.lit(90.0)))
    bare, calm = style.cropped(F.create_map(F.lit("x"), F.lit(0.1)))
    r = spark.range(1).select(
        crop, reasons, bare, calm, keywords.condensed(F.lit(["b", "a", "b", "c", "d", "e", "f"])), keywords.condensed(F.array().cast("array<string>")),
        taxonomy.worth_asking(none), taxonomy.worth_asking(F.lit(0.1)), taxonomy.worth_asking(F.lit(0.1), gate=False),
        histogram.top_mean(F.lit([1.0, 9.0, 3.0]), 0.5), histogram.top_mean(F.lit([1.0, 9.0]), 0.0), histogram.top_mean(F.array().cast("array<double>"), 0.5),
    ).first()
    assert tuple(r) == ({"angle": 45.0}, ["top_not_before_bottom"], {}, [], "b | a | c | d | e", "", True, False, True, 6.0, 9.0, 0.0)


def test_outcomes_without_examples(spark):
    scored = spark.createDataFrame([(1, 0.8, 7, None), (1, 0.8, 3, "n")], "request int, score double, id int, name string")
    requests = spark.createDataFrame([(1,), (2,)], "request int")
    assert [tuple(r) for r in style.outcome(scored, requests, 4).orderBy("request").collect()] == [(i, "none", 0.0, 0, [], "too_few_examples") for i in (1, 2)]
    assert [tuple(r) for r in style.outcome(scored, requests, 5).orderBy("request").collect()] == [(1, "style", 0.8, 2, ["n", "7"], None), (2, "none", 0.0, 0, [], "nothing_found")]


def test_histogram_of_few_values(spark):
    values = spark.createDataFrame([("g", -1.0), ("g", 0.5), ("g", 2.0), ("g", None)], "g string, v double")
    bins = histogram.binned(values, "g", "v")
    assert rows(bins, "bin", "n") == {(0, 1), (128, 1), (255, 1)}
    assert rows(histogram.percentiles(bins, "g", {"low": 0.0, "mid": 0.5, "high": 7.0}), "low", "mid", "high") == {(0.0, 128 / 255, 1.0)}


@pytest.mark.parametrize("per_slice", [1 << 18, 10])
def test_positions(spark, per_slice):
    rows = spark.range(1000).select(F.xxhash64("id").alias("x"), (F.col("id") % 7).alias("k"), F.col("id").alias("row"))
    found = ordering.positions(rows, [F.desc("k"), F.asc("x")], "at", per_slice).collect()
    want = sorted(found, key=lambda r: (-r.k, r.x))
    assert [r.at for r in want] == list(range(1, 1001)) and [c for c in found[0].asDict()] == ["x", "k", "row", "at"]
    assert ordering.positions(rows.limit(0), [F.asc("x")], "at").collect() == []

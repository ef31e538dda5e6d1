"""Greedy and order-dependent operators on small hand-made rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import scalar, vector
from lumenlake.operators import catalog, clustering, grouping, keywords, ranking, search, style
from lumenlake.sources import photos as source


def results(spark, distances):
    return spark.createDataFrame([(i, float(d)) for i, d in enumerate(distances)], "id long, distance double")


@pytest.mark.parametrize(
    ("distances", "kept"),
    [
        ([0.1 + i / 1000 for i in range(10)] + [0.9 + i / 1000 for i in range(10)], 10),
        ([0.1, 0.11] + [0.9 + i / 1000 for i in range(10)], 8),
        ([0.1, 0.5, 0.9], 3),
        ([], 0),
    ],
)
def test_relevance_cut(spark, distances, kept):
    assert search.relevant(results(spark, distances)).count() == kept
    assert search.relevant(results(spark, distances), 0).count() == len(distances)


def test_cosine_variants(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    a, z = F.col("a"), F.col("z")
    got = r.select(vector.cosine_or_one(a, z), vector.cosine_or_null(a, z), vector.cosine_or_one(a, a), vector.present(z).isNull(), vector.norm(a), vector.squared_l2(a, z)).first()
    assert tuple(got) == (1.0, None, pytest.approx(0.0), True, 5.0, 25.0)


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.round_even(F.lit(0.00005), 4), scalar.round_away(F.lit(-2.25), 1), scalar.hamming(scalar.hash64(F.lit("ffffffffffffffff")), scalar.hash64(F.lit("0" * 16))), scalar.clamp(F.lit(None).cast("double"), 0, 1),
        F.array_join(scalar.string_set(F.lit('["b", "", "a", "b"]')), ","), F.size(scalar.string_set(F.lit("junk"))), scalar.photo_id(F.lit(" "), F.lit("u")), scalar.time_proximity(F.lit("dawn"), F.lit("night")), scalar.time_proximity(F.lit("?"), F.lit("night")),
        scalar.stable_id(F.lit(None), F.lit("")), scalar.jaccard_tags(F.array().cast("array<string>"), F.array(F.lit("a"))), scalar.is_set(F.lit("false")), scalar.is_raw_name(F.lit("a.b.NEF")), scalar.degrees(F.lit(10), F.lit(30), F.lit(0), F.lit("w")), scalar.wrapped(F.lit(190.0), -180.0, 180.0),
    ).first()
    assert tuple(r) == (0.0, -2.3, 64, None, "a,b", 0, None, pytest.approx(0.65), 0.5, None, 0.3, False, True, -10.5, -170.0)


def test_golden_pair(spark):
    """Published scores of a pair under the parity preset."""
    schema = "group_id string, id string, sharpness double, peak double, exposure double, noise double, stored_technical double, highlight double, shadow double, heuristic double, iqa double, face_count long, face_score double, face_sharpness double, face_prominence double, face_visibility double, eye double, blink double, occlusion double, anisotropy double, semantic double"
    n = [None] * 11
    rows = [("g", "p1", 0.9, None, 0.6, 0.1, 0.85, None, None, 0.7, *n), ("g", "p2", 0.4, None, 0.55, 0.3, 0.5, None, None, 0.6, *n)]
    got = {r.id: r for r in ranking.judged(spark.createDataFrame(rows, schema), grouping.PRESETS["python_parity"]).collect()}
    assert got["p1"].score == pytest.approx(0.8389, abs=1e-4) and got["p2"].score == pytest.approx(0.5074, abs=1e-4)
    assert (got["p1"].rank, got["p1"].reject, got["p2"].reject) == (1, False, True) and "near_duplicate_weaker" in got["p2"].reasons


FRAMES = "id long, time double, hash long, vector array<float>, ev double"


def groups(spark, rows, t, **kw):
    f = spark.createDataFrame(rows, FRAMES)
    links = grouping.edges(f, t, **kw)
    return {r.id: r for r in grouping.numbered(grouping.grouped(f, links, t)).collect()}


def test_grouping_windows(spark):
    t = grouping.thresholds("default", window=1)
    far = groups(spark, [(i, 60.0 * i, 5, None, None) for i in range(3)], t)
    assert {r.group_type for r in far.values()} == {"single"} and sorted(r.group_id for r in far.values()) == ["group_0001", "group_0002", "group_0003"]
    chain = groups(spark, [(i, 3.0 * i, 5, None, None) for i in range(12)], t)
    assert {(r.component, r.size, r.group_type) for r in chain.values()} == {(0, 12, "near_duplicate")}
    undated = groups(spark, [(1, 0.0, 5, None, None), (2, None, 5, None, None), (3, 9999.0, 5, None, None), (4, None, -1, None, None)], t)
    assert {undated[i].component for i in (1, 2, 3)} == {1} and undated[4].component == 4


def test_edges_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 60), rng.getrandbits(3), [rng.random(), rng.random()], rng.choice([None, 0.0, 1.0])) for i in range(60)]
    t = grouping.Thresholds(4.0, 0.02, 0, 0.001, 10.0)
    want = {}
    for x, y in itertools.combinations(rows, 2):
        gap = abs(x[1] - y[1])
        cos = 1 - np.dot(x[3], y[3]) / np.linalg.norm(x[3]) / np.linalg.norm(y[3])
        kind = None
        if x[4] is not None and y[4] is not None and abs(x[4] - y[4]) > 0.34 and gap <= t.window:
            kind = "bracket_candidate"
        elif gap <= t.duplicate_window and (x[2] == y[2] or cos <= t.duplicate):
            kind = "near_duplicate"
        elif cos <= t.burst and gap <= t.window:
            kind = "burst"
        if kind:
            want[frozenset((x[0], y[0]))] = kind
    got = {frozenset((r.a, r.b)): r.kind for r in grouping.edges(spark.createDataFrame(rows, FRAMES), t).collect()}
    assert got == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in grouping.components(spark.range(103), links).collect()}
    assert {got[i] for i in range(71)} == {0} and got[101] == 100 and got[102] == 102


def test_sets(spark):
    schema = "group_id string, id long, time double, ev double, hash long, vector array<double>, x double, y double"
    turn = lambda a: [math.cos(a), math.sin(a)]
    rows = [("b", i, float(i), float(i) - 1, 1, None, None, None) for i in range(3)]
    rows += [("slow", i, 10.0 * i, float(i), 1, None, None, None) for i in range(3)]
    rows += [("f", i, float(i), None, 7, None, 0.1 * i, 0.0) for i in range(3)]
    rows += [("p", i, float(i), None, -(i % 2), turn(0.5 * i), None, None) for i in range(4)]
    rows += [("two", i, float(i), float(i), 1, None, None, None) for i in range(2)]
    got = {r.group_id: r.kind for r in ranking.intentional_sets(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"b": "bracket", "f": "focus_stack", "p": "panorama"}


def brute_agglomerate(x, threshold, linkage):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    groups = [[i] for i in range(len(x))]
    f = np.max if linkage == "complete" else np.mean
    while len(groups) > 1:
        best, i, j = min((f(d[np.ix_(a, b)]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if best > threshold:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_agglomerate(linkage):
    rng = np.random.default_rng(0)
    for t in (0.3, 0.9):
        x = rng.normal(size=(40, 2))
        labels = clustering.agglomerate(x, t, linkage)
        assert {frozenset(i for i, g in enumerate(labels) if g == k) for k in set(labels)} == brute_agglomerate(x, t, linkage)
    seeded = clustering.agglomerate(np.array([[0.0, 0], [9, 0], [0.1, 0], [9.1, 0], [0.2, 0]]), 100, "complete", [1, 1, 2, None, None])
    assert seeded[0] == seeded[1] != seeded[2]
    assert clustering.agglomerate(np.zeros((0, 2)), 1) == [] and clustering.canopies(np.array([[0.0], [1], [0.4], [3]]), 0.5) == [0, 1, 0, 2]


def brute_dbscan(x, eps, least):
    near = [[j for j in range(len(x)) if 1 - x[i] @ x[j] <= eps] for i in range(len(x))]
    core = {i for i, n in enumerate(near) if len(n) >= least}
    seen, out = set(), set()
    for i in sorted(core):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k in group:
                continue
            group.add(k)
            todo += [j for j in near[k] if j in core]
        seen |= group
        out.add(frozenset(group))
    return core, out


def test_dbscan_and_cliques(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 2 * np.pi, 60)
    x = np.stack([np.cos(a), np.sin(a)], axis=1)
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vector array<double>")
    for least in (2, 4):
        core, want = brute_dbscan(x, 0.002, least)
        got = {r.id: r.cluster for r in clustering.dbscan(points, 0.002, least).collect()}
        assert {frozenset(i for i in core if got[i] == k) for k in {got[i] for i in core}} == want
    near = {(i, j) for i, j in itertools.combinations(range(60), 2) if 1 - x[i] @ x[j] <= 0.01}
    rows = [tuple(r) for r in clustering.cliques(points, 0.99).collect()]
    assert len({i for _, i in rows}) == len(rows)
    for c in {c for c, _ in rows}:
        assert all((i, j) in near for i, j in itertools.combinations(sorted(i for k, i in rows if k == c), 2))


def test_persons(spark):
    old = spark.createDataFrame([(1, "person_3"), (2, "person_3"), (3, "person_7"), (4, "person_7"), (5, "x")], "face long, person string")
    new = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (9, 1), (4, 2), (10, 3), (11, 3)], "face long, label long")
    assert {r.label: r.person for r in clustering.matched_persons(old, new).collect()} == {0: "person_3", 2: "person_7", 3: "person_8", 1: "person_9"}


def test_faces(spark):
    at = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, at(0.0), 0.9, False, None), (2, at(0.1), 0.8, False, None), (3, at(3.0), 0.9, False, "person_1"), (4, at(0.05), 0.1, True, None), (5, at(1.6), 0.5, False, None)]
    faces = spark.createDataFrame(rows, "id long, vector array<double>, quality double, weak boolean, pinned string")
    got = {r.id: (r.cluster, r.how) for r in clustering.clustered_faces(faces, cosine=0.05).collect()}
    assert got == {1: (1, "clustered"), 2: (1, "clustered"), 3: (3, "clustered"), 4: (1, "attached"), 5: (None, "unassigned")}


def test_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 8.0, 8.0, 10.0, 10.0, 0.7), (2, 1, 0.0, 0.0, 1.0, 1.0, 0.1)]
    boxes = spark.createDataFrame(rows, "image long, id long, x double, y double, w double, h double, score double")
    assert sorted((r.image, r.id) for r in clustering.suppressed(boxes).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_prefixes_are_literal(spark):
    ids = spark.createDataFrame([("photo_1_0",), ("photo_10_0",), ("photoX1_0",), ("a'b",)], "id string")
    assert [r.id for r in catalog.by_prefix(ids, "photo_1_").collect()] == ["photo_1_0"]
    assert catalog.without_prefix(ids, "photo_1_").count() == 3


def test_merged_keywords(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(["Cat", "dog", "cats", "CAT"])] + [(2, i, f"w{i % 700}") for i in range(5000)], "id int, pos int, word string")
    got = {r.id: r.keywords for r in keywords.merged(rows, "id", "word", "pos", {"cat": "Cats"}).collect()}
    assert got == {1: ["Cats", "dog"], 2: [f"w{i}" for i in range(700)]}


def test_search_without_fields(spark):
    rows = spark.createDataFrame([(1, "A cat", None), (2, None, "cats"), (3, "dog", "cow")], "id int, title string, alt_text string")
    assert [r.id for r in search.matching(rows, "CAT").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in search.matching(rows, "cat", ["title", "no such"]).collect()] == [1]


def test_unprocessed_photos(spark):
    asked = spark.createDataFrame([(i, -i) for i in range(4)], "id int, position int")
    keys = ("has_embedding", "title", "caption", "alt_text", "keywords", "cull_phash", "cull_faces_present", "faces_checked", "face_model", "species_checked", "species_model")
    row = lambda i, **own: (i, ["a"], *(own.get(k) for k in keys))
    photos = spark.createDataFrame([row(0, has_embedding="true", cull_phash="x"), row(1, has_embedding="", cull_phash="x"), row(2, has_embedding="true", species_checked="true", species_model="old", cull_phash="x", cull_faces_present="false")], "id int, catalogs array<string>, " + ", ".join(f"{k} string" for k in keys))
    faces, cloud = spark.createDataFrame([("2_0",)], "face_id string"), spark.createDataFrame([(1,)], "id int")
    left = lambda tasks, **more: [r.id for r in catalog.unprocessed_photos(asked, photos, faces, cloud, tasks, **({"regenerate": False} | more)).collect()]
    assert left(["embeddings"]) == [3, 1] and left(["embeddings"], regenerate=True) == [3, 2, 1, 0] and left(["nothing"]) == []
    assert left(["embeddings"], owner="b") == [3, 2, 1, 0]
    assert left(["vertexai"]) == [3, 2, 0] and left(["cull"]) == [3, 1, 0]
    assert left(["species"]) == [3, 1, 0] and left(["species"], species_model="new") == [3, 2, 1, 0]
    assert left(["faces"]) == [3, 2, 1, 0]


def test_large_blocks_are_an_error(spark, monkeypatch):
    with pytest.raises(Exception, match="more than"):
        rows = [(i, 0, [1.0, float(i)]) for i in range(6001)]
        clustering.agglomerated(spark.createDataFrame(rows, "id int, label int, vector array<double>"), 0.1, block="label").count()


def test_fitted_moves(spark):
    got = spark.range(1).select(style.fitted(F.array(F.lit(30.0), F.lit(-5.0), F.lit(20.0)), F.lit(25.0))).first()[0]
    assert got == [15.0, -5.0, 10.0]


def test_promotion(spark):
    rows = [("a", [1.0, 2.0], '{"capture_time": 5.5, "faces_checked": "true", "catalog_ids": "[\\"x\\"]", "other": 1}'), ("b", [1.0], "junk"), ("c", None, None)]
    good, bad = source.validated(spark.createDataFrame(rows, "id string, vector array<float>, metadata string"), 2)
    got = {r.id: r for r in source.promoted(good).collect()}
    assert [r.id for r in bad.collect()] == ["b"] and sorted(got) == ["a", "c"]
    assert (got["a"].capture_time, got["a"].faces_checked, got["a"].catalogs) == (5.5, True, ["x"]) and got["c"].catalogs == []
    assert got["c"].has_embedding is True


def test_label_ranks(spark):
    from lumenlake.operators.evaluation import label_ranks

    rows = [("a", 1, 0, 5), ("a", 2, 1, 0), ("a", 3, -1, 5), ("a", 4, None, None), ("b", 1, 0, 0), ("b", 2, None, 0), ("c", 1, -1, 0)]
    got = label_ranks(spark.createDataFrame(rows, "g string, at int, pick int, stars int"), "g", "pick", "stars", "at")
    assert {(r.g, r.at): (r["rank"], r.reject) for r in got.collect()} == {
        ("a", 2): (1, False), ("a", 1): (2, False), ("a", 3): (3, True), ("a", 4): (4, False), ("b", 1): (None, False), ("b", 2): (None, False), ("c", 1): (1, True),
    }


def test_condensed_messages(spark):
    from lumenlake.operators.keywords import summaries

    rows = [("x", i, m) for i, m in enumerate(["b", "a", "b", "c", "d", "e", "f", "g", None])] + [("y", 0, "a"), ("y", 1, "a"), ("z", 0, None)]
    got = summaries(spark.createDataFrame(rows, "run string, at int, m string"), "run", "m", "at")
    assert {r.run: r.messages for r in got.collect()} == {"x": "b\na\nc\nd\ne\n...and 2 more", "y": "a"}

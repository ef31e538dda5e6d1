"""Fixtures, reports on them, imports and migrations against small cases worked out by hand."""

import json

import pytest

from lumenlake.operators import imports, reports
from lumenlake.sources import fixtures

LABELS = "fixture string, authoritative boolean, group_id string, intentional_set string, at int, photo_id string, rank long, reject boolean"
PRODUCED = "fixture string, photo_id string, group string, score double, reject boolean, keep_all boolean"


def report(spark, labels, produced):
    out = reports.measured(reports.reports(spark.createDataFrame(labels, LABELS), spark.createDataFrame(produced, PRODUCED)))
    return {r.fixture: r.asDict() for r in out.collect()}


def burst(fixture="f", authoritative=True, first="a"):
    return [(fixture, authoritative, "g", None, 0, "a", 1 if first == "a" else 2, False), (fixture, authoritative, "g", None, 1, "b", 2 if first == "a" else 1, True), (fixture, authoritative, "g", None, 2, "c", None, False)]


def made(fixture="f", split=False):
    return [(fixture, "a", "1", 0.9, False, False), (fixture, "b", "1", 0.5, True, False), (fixture, "c", "2" if split else "1", 0.4, False, False)]


def test_a_perfect_burst(spark):
    r = report(spark, burst(), made())["f"]
    assert (r["ranked_groups"], r["winner_hits"], r["winner_accuracy"]) == (1, 1, 1.0) and r["ndcg"] == pytest.approx(1)
    assert (r["rejects_predicted"], r["rejects_labelled"], r["rejects_correct"]) == (1, 1, 1)
    assert (r["pairs_predicted"], r["pairs_labelled"], r["pairs_correct"]) == (3, 3, 3)


def test_a_wrong_winner_and_a_split_group(spark):
    r = report(spark, burst(first="b"), made(split=True))["f"]
    assert r["winner_hits"] == 0 and 0 < r["ndcg"] < 1
    assert (r["pairs_predicted"], r["pairs_labelled"], r["pairs_correct"]) == (1, 3, 1) and r["grouping_recall"] == pytest.approx(1 / 3)


def test_groups_that_nobody_judged_have_no_pairs(spark):
    r = report(spark, burst(authoritative=False), made())["f"]
    assert r["pairs_predicted"] == r["pairs_labelled"] == 0 and r["grouping_precision"] == 0.0 and r["winner_hits"] == 1


@pytest.mark.parametrize("case, preserved, recognised", [("whole", 1, 1), ("split", 1, 0), ("rejected", 0, 1), ("missing", 0, 0), ("larger", 1, 0), ("not kept", 1, 0)])
def test_intentional_sets(spark, case, preserved, recognised):
    labels = [("f", True, "s", "bracket", i, p, 1, True) for i, p in enumerate("xyz")]
    produced = [("f", p, "2" if case == "split" and p == "z" else "1", 0.5, case == "rejected" and p == "y", case != "not kept") for p in "xyz" if not (case == "missing" and p == "z")]
    produced += [("f", "w", "1", 0.1, False, True)] if case == "larger" else []
    r = report(spark, labels, produced)["f"]
    assert (r["sets_labelled"], r["sets_preserved"], r["sets_recognised"]) == (1, preserved, recognised)
    assert r["ranked_groups"] == 0 and r["rejects_labelled"] == 0  # labels of a set's frames don't count


def test_a_corpus_weighs_by_groups(spark):
    labels = burst("one") + [(f, a, f"{g}{k}", s, at, f"{p}{k}", r, j) for k in range(3) for f, a, g, s, at, p, r, j in burst("two", first="b")]
    produced = made("one") + [(f, f"{p}{k}", f"{g}{k}", s, j, c) for k in range(3) for f, p, g, s, j, c in made("two")]
    each = reports.reports(spark.createDataFrame(labels, LABELS), spark.createDataFrame(produced, PRODUCED))
    one, two = (r.ndcg_sum for r in sorted(each.collect(), key=lambda r: r.fixture))
    whole = reports.measured(reports.corpus(each, "all")).first()
    assert whole.ranked_groups == 4 and whole.winner_accuracy == 0.25 and whole.ndcg == pytest.approx((one + two) / 4)
    none = reports.measured(reports.corpus(each.limit(0), "none")).first()
    assert none.ranked_groups == 0 and none.ndcg == 0.0 and none.grouping_recall == 0.0


def test_fixtures(spark, tmp_path):
    good = {"name": "shoot", "groups": [{"group_id": "g", "photos": [{"photo_id": "p", "phash": "ffffffffffffffff", "metadata": {"cull_sharpness": 0.5}}, {"photo_id": "q", "phash": "no", "rank": 1, "reject": True, "filename": "q.nef"}]}]}
    texts = {"good": json.dumps(good, indent=1), "broken": "{", "list": "[1]", "nameless": '{"groups": []}', "empty": '{"name": "x"}', "no id": '{"name": "y", "groups": [{"group_id": "g", "photos": [{"rank": 1}]}]}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    photos, rejected = fixtures.parsed(fixtures.read(spark, str(tmp_path)))
    p, q = sorted(photos.collect(), key=lambda r: r.at)
    assert (p.fixture, p.preset, p.authoritative, p.filename, p.hash, p["rank"], p.reject) == ("shoot", "default", False, "p.jpg", -1, None, False)
    assert (q.filename, q.hash, q["rank"], q.reject, q.intentional_set) == ("q.nef", None, 1, True, None)
    told = {r.source.rsplit("/", 1)[1].replace("%20", " ").removesuffix(".json"): r.reason for r in rejected.collect()}
    assert told == {"broken": "no fixture", "list": "no fixture", "nameless": "no name", "empty": "no groups", "no id": "a group or photo without an id"}


def test_import(spark):
    items = [
        (1, '{"photo_id": "a", "title": "one", "keywords": {"Animals": ["Dog"]}}'), (2, '{"photo_id": "a", "title": "two", "caption": ""}'), (3, '{"uuid": "b", "alt_text": "text"}'),
        (4, '{"photo_id": "c", "keywords": []}'), (5, '{"photo_id": 5, "title": "x"}'), (6, "[]"), (7, None), (8, '{"photo_id": "d", "uuid": "u", "keywords": "plain"}'),
    ]
    rows, counts = imports.judged_items(spark.createDataFrame(items, "position int, item string"))
    assert counts == {"imported": 4, "failed": 4}
    assert {r.position: r.outcome for r in rows.collect() if r.outcome != "imported"} == {4: "no metadata", 5: "no id", 6: "no object", 7: "no object"}
    photos = spark.createDataFrame([("a", [1.0], {"title": "old", "rating": "5", "catalog_ids": '["z"]'}), ("e", None, {"title": "kept"})], "id string, vector array<double>, metadata map<string,string>")
    got = {r.id: (r.vector, r.metadata) for r in imports.imported(photos, rows, "now", "k").collect()}
    own = lambda i, **more: {"run_date": "now", "photo_id": i, "catalog_ids": '["k"]', "uuid": i} | more
    assert got == {
        "a": ([1.0], own("a", title="two", keywords='{"Animals":["Dog"]}', flattened_keywords="Animals, Dog", rating="5", catalog_ids='["k","z"]')),
        "b": (None, own("b", alt_text="text")),
        "d": (None, own("u", keywords='"plain"', flattened_keywords="plain", uuid="u")),
        "e": (None, {"title": "kept"}),
    }
    rows, counts = imports.judged_items(spark.createDataFrame([], "position int, item string"))
    assert counts == {"imported": 0, "failed": 0} and imports.imported(photos, rows, "now").count() == 2


def test_migration(spark):
    records = [("t", "a", [1.0, 2.0], True), ("t", "b", [1.0], True), ("t", "c", None, True), ("t", "d", [0.0, 0.0], False), ("t", "e", None, False), ("t", "f", [1.0, 1.0], None), ("x", "g", [1.0], True)]
    log = [("t", "a", 1, "write", [5.0, 6.0]), ("t", "a", 2, "write", None), ("t", "f", 1, "write", [9.0, 9.0]), ("t", "f", 2, "delete", None), ("t", "c", 1, "write", [3.0, 3.0])]
    rows, counts, skipped = imports.migrated(
        spark.createDataFrame([(*r, "{}") for r in records], "table string, id string, vector array<double>, has_embedding boolean, metadata string"), spark.createDataFrame(log, "table string, id string, seq int, op string, vector array<double>"), {"t": 2}
    )
    got = {r.id: (r.vector, r.needs_reembedding) for r in rows.collect()}
    assert got == {"a": ([5.0, 6.0], False), "b": (None, True), "c": ([3.0, 3.0], False), "d": (None, False), "e": (None, False), "f": (None, True)}
    assert [tuple(r) for r in imports.verified(counts).collect()] == [("t", 6, 6, 2)] and [tuple(r) for r in skipped.collect()] == [("x", 1)]
    short = counts.withColumn("migrated", counts.migrated - 1)
    with pytest.raises(Exception, match="rows are missing in t"):
        imports.verified(short).collect()


def test_cache_and_order(spark):
    links = spark.createDataFrame([("a", True, "2024-01-01 00:00:00"), ("b", False, "2024-01-01 00:00:00"), ("c", True, "2023-01-01 00:00:00"), ("c", False, "2024-01-01 23:00:00")], "key string, resolved boolean, fetched_at string")
    assert {r.key for r in imports.cached(links, "2024-01-02 00:00:00", 86401, 86400).collect()} == {"a", "c"}
    ids = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, ""), (5, None)], "position int, id string")
    assert [tuple(r) for r in imports.in_order(ids).collect()] == [(1, "b"), (2, "a")]

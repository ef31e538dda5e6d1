"""Keyword trees against walks in plain Python, on trees of random shape and on awkward ones."""

import json
import random

import pytest

from lumenlake.operators import catalog, keywords, trees

LISTS = ("synonyms", "aliases", "synonym_aliases")


def spoken(value, seen):
    texts = [value] if isinstance(value, str) else []
    if isinstance(value, dict):
        texts = [value.get("name"), *(x for f in LISTS if isinstance(value.get(f), list) for x in value[f])]
    out = []
    for t in (t.strip() for t in texts if isinstance(t, str)):
        if t and t.lower() not in seen:
            seen.add(t.lower())
            out.append(t)
    return out


def flat(tree):
    seen, out = set(), []
    if isinstance(tree, str):
        return tree
    if isinstance(tree, list):
        return ", ".join(t for x in tree for t in spoken(x, seen))

    def walk(node):
        for k, v in sorted(node.items()):
            out.extend(spoken(k, seen))
            if isinstance(v, list):
                out.extend(t for x in v for t in spoken(x, seen))
            elif isinstance(v, dict) and v and "name" not in v:
                walk(v)
            else:
                out.extend(spoken(v, seen))

    if isinstance(tree, dict):
        walk(tree)
    return ", ".join(out)


def merged(value, pairs):
    if isinstance(value, list):
        out, seen = [], set()
        for x in (merged(x, pairs) for x in value):
            if isinstance(x, str):
                if x.lower() in seen:
                    continue
                seen.add(x.lower())
            out.append(x)
        return out
    if isinstance(value, dict):
        return {k: merged(v, pairs) for k, v in value.items()}
    return pairs.get(value.lower(), value) if isinstance(value, str) else value


def grown(rng, depth):
    word = lambda: rng.choice(["a", "B", "b ", "Ünter", 'q"uote', "c>d", "", " ", "e\\f", "name2"])
    kind = rng.randrange(8) if depth else rng.choice([0, 1, 2])
    if kind <= 1:
        return word()
    if kind == 2:
        return rng.choice([3, 1.5, None, True, {}, []])
    if kind == 3:
        return {"name": rng.choice([word(), 5, None]), "synonyms": rng.choice([[word(), 4, word()], "x"]), "aliases": [word()], "zoo": ["z"]}
    if kind == 4:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("KLMNOPQ") + rng.choice(["", " x"]): grown(rng, depth - 1) for _ in range(rng.randrange(1, 4))}


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(5)
    fixed = [None, "{", "", '"  text "', "[]", "{}", "7", "null", '{"name": "x"}', '["a", ["b"], {"c": "d"}]', '{"":{"":["a"]}}', json.dumps({"a": {"b": {"c": {"d": {"e": ["deep"]}}}}})]
    return list(enumerate(fixed + [json.dumps(grown(rng, 5)) for _ in range(80)]))


def parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


@pytest.fixture(scope="module")
def found(spark, forest):
    return trees.nodes(spark.createDataFrame(forest, "id int, tree string"))


def test_flattened(found, forest):
    got = {r.id: r.text for r in trees.flattened(found).collect()}
    assert got == {i: flat(parsed(t)) for i, t in forest if parsed(t) is not None and flat(parsed(t))}


def test_assembled(found, forest):
    got = {r.id: json.loads(r.tree) for r in trees.assembled(found).collect()}
    assert got == {i: parsed(t) for i, t in forest if t == "null" or parsed(t) is not None}


def test_replaced(spark, found, forest):
    rows = [(" A", "b", 1), ("ünter", "x", 1), ("ünter", "Unter", 2), ("b ", "B", 3), ("", "q", 4), ("text", "no", 5)]
    out = trees.replaced(found, spark.createDataFrame(rows, "duplicate string, canonical string, position int"))
    got = {r.id: json.loads(r.tree) for r in trees.assembled(out).collect()}
    want = {i: merged(parsed(t), {"a": "b", "ünter": "Unter"}) for i, t in forest if t == "null" or parsed(t) is not None}
    assert got == want
    changed = {r.id for r in out.filter("changed").select("id").distinct().collect()}
    assert changed == {i for i, t in forest if parsed(t) is not None and json.dumps(want[i]) != json.dumps(parsed(t))}


def test_leaves_and_hierarchies(spark):
    tree = {"A": {"B": ["x", {"name": " y ", "synonyms": ["Y", " z", "Z"], "aliases": ["y", "w"], "synonym_aliases": ["z", "v"]}, "x"], "12": ["n"]}, "C": "C", "D": "e"}
    found = trees.nodes(spark.createDataFrame([(1, json.dumps(tree))], "id int, tree string"))
    got = [(r.keyword_id, r.name, r.path, r.synonyms, r.aliases, r.synonym_aliases) for r in sorted(trees.leaves(found).collect(), key=lambda r: r.keyword_id)]
    assert got == [("kw_1", "n", "A", [], [], []), ("kw_2", "x", "A > B", [], [], []), ("kw_3", "y", "A > B", ["z"], ["w"], ["v"]), ("kw_4", "C", "", [], [], []), ("kw_5", "e", "D", [], [], [])]
    items = [(1, 1, "A > B > x", '"x"'), (1, 2, " A>B>y", '{"name":"y"}'), (1, 3, "A > z", '"z"'), (1, 4, "top", '"top"'), (1, 5, "> C > > w", '"w"'), (1, 6, "A > ", '"lost"'), (2, 1, "only", '"only"')]
    rows = spark.createDataFrame(items, "id int, position int, p string, leaf string").withColumn("path", trees.split_path(trees.F.col("p"))).filter("path IS NOT NULL")
    rows = rows.withColumn("path", trees.F.expr("slice(path, 1, size(path) - 1)"))
    got = {r.id: json.loads(r.tree) for r in trees.hierarchies(rows).collect()}
    assert got == {1: {"": ["top"], "A": {"": ["z"], "B": ["x", {"name": "y"}]}, "C": ["w"]}, 2: ["only"]}
    assert trees.hierarchies(rows.limit(0)).collect() == [] and trees.assembled(found.limit(0)).collect() == []


def test_paths(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(70)] + [(100, 999, "orphan")]
    got = {r.node: r.path for r in trees.paths(spark.createDataFrame(rows, "node int, parent int, name string")).collect()}
    assert got == {i: [f"n{k}" for k in range(i + 1)] for i in range(70)} | {100: ["orphan"]}
    with pytest.raises(ValueError, match="circle"):
        trees.paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "node int, parent int, name string"))


def test_labels(spark):
    # The second path's own name is the first's full path, and the fourth repeats the third.
    rows = [(1, ["Nature", "Land"]), (2, ["Nature/Land"]), (3, ["Travel", "Land"]), (4, ["travel", "LAND"]), (5, [" People ", ""]), (6, ["Sea", "People "]), (7, ["Sky"])]
    labels = trees.category_labels(spark.createDataFrame(rows, "position int, path array<string>"))
    assert {(r.position, r.label) for r in labels.collect()} == {(1, "Nature/Land"), (3, "Travel/Land"), (5, "People"), (6, "Sea/People"), (7, "Sky")}
    asked = spark.createDataFrame([(x,) for x in ["sky", " /Sky/ ", "NATURE \\ land", "sea > people", "people", "Land", "", "/", None, "nothing"]], "label string")
    got = {r.label: r.path for r in trees.resolved(asked, labels).collect()}
    assert got == {"sky": ["Sky"], " /Sky/ ": ["Sky"], "NATURE \\ land": ["Nature", "Land"], "sea > people": ["Sea", "People"], "people": ["People"], "Land": None, "": None, "/": None, None: None, "nothing": None}


@pytest.mark.parametrize("bilingual, aliases", [(False, False), (False, True), (True, False), (True, True)])
def test_regrouped(spark, bilingual, aliases):
    items = ["one", {"name": "two"}, ["three", "drei", "3"], ["four"], [], [["five", "5"], ["fünf", "V", "v"]], [[], ["x"]], [["six"]], None]

    def read(x):
        if not isinstance(x, list) or not (bilingual or aliases):
            return x
        if bilingual and aliases and any(isinstance(s, list) for s in x):
            group = lambda i: x[i] if i < len(x) and isinstance(x[i], list) else []
            a, b = group(0), group(1)
            return {k: v for k, v in {"name": a[0], "aliases": a[1:], "synonyms": b[:1], "synonym_aliases": b[1:]}.items() if v or k == "name"} if a else None
        return {k: v for k, v in {"name": x[0], "synonyms" if bilingual else "aliases": x[1:]}.items() if v or k == "name"} if x else None

    answers = [
        (1, json.dumps([{"category": "Land", "items": items}, {"category": "none", "items": ["k"]}, {"category": 3, "items": ["k"]}, {"category": "Sea", "items": "k"}, "junk"])),
        (2, '["a", "b"]'), (3, "{"), (4, '{"Old": ["shape"]}'), (5, '[{"category": "Land", "items": []}]'), (6, None),
    ]
    labels = trees.category_labels(spark.createDataFrame([(1, ["Nature", "Land"]), (2, ["Sea"])], "position int, path array<string>"))
    got = {r.id: json.loads(r.tree) for r in trees.regrouped(spark.createDataFrame(answers, "id int, groups string"), labels, bilingual, aliases).collect()}
    want = [y for y in map(read, items) if y is not None]
    assert got == {1: {"Nature": {"Land": want}, "none": ["k"]}, 2: ["a", "b"], 4: {"Old": ["shape"]}, 5: {}}


def test_vocabulary(spark):
    uses = spark.createDataFrame([("Dog", 2, 3), ("dog ", 1, 2), ("cat", 3, 1), ("Bird", 1, 4), ("ant", 1, 5), (" ", 9, 6), (None, 9, 7)], "name string, uses int, position int")
    rows = lambda pinned, most: [(r.name, r.uses) for r in keywords.vocabulary(uses, pinned, most).collect()]
    assert rows(["CAT", "cat", " Zebra ", ""], 4) == [("Bird", 1), ("CAT", 3), ("Zebra", 0), ("dog", 3)]
    assert rows(["x", "y", "z"], 2) == [("x", 0), ("y", 0)]
    assert rows([], 1) == [("cat", 3)]


def test_persons_with_ids_of_text(spark):
    faces = spark.createDataFrame([("b", "p", "x", True, 0.5, "tb"), ("a", "p", "x", None, 0.5, "ta"), ("c", "q", "x", False, None, "tc"), ("d", "q", "", False, 0.9, " ")], "face_id string, photo_id string, person string, manual boolean, quality double, thumbnail string")
    got = {r.person: (r.faces, r.manual, r.photos, r.thumbnail) for r in catalog.persons(faces, spark.createDataFrame([], "person string, name string")).collect()}
    assert got == {"x": (3, 1, 2, "ta"), "_unassigned": (1, 0, 1, None)}

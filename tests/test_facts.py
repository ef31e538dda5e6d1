"""Facts of groups against loops, and tolerant parsing of replies, names, tasks and scenes."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import parsing
from lumenlake.operators import facts, replies, style, taxonomy

SCHEMA = "id long, `group` string, time double, hash long, vector array<float>"


def loop(rows, links):
    out = {}
    for g in {r[1] for r in rows if r[1] is not None}:
        own = [r for r in rows if r[1] == g]
        times = [r[2] for r in own if r[2] is not None]
        unit = [np.array(r[4]) / np.linalg.norm(r[4]) for r in own if r[4] is not None and any(r[4])]
        apart = [1 - float(a @ b) for a, b in combinations(unit, 2)]
        bits = [((a ^ b) & (1 << 64) - 1).bit_count() for a, b in combinations([r[3] for r in own if r[3] is not None], 2)]
        ids = {r[0] for r in own}
        out[g] = (
            len(own), min(times, default=None), max(times, default=None), round(max(times) - min(times), 3) if len(times) > 1 else 0.0, sorted({k for a, b, k in links if a in ids and b in ids}),
            len(apart), *((np.mean(apart), min(apart), max(apart)) if apart else (None,) * 3), len(bits), *((np.mean(bits), min(bits), max(bits)) if bits else (None,) * 3),
        )
    return out


@pytest.mark.parametrize("part, shared", [(1024, 32768), (3, 4)])
def test_group_facts(spark, monkeypatch, part, shared):
    whole = facts.extremes
    monkeypatch.setattr(facts, "extremes", lambda m: whole(m, part, shared))
    random = np.random.default_rng(7)
    vector = lambda: [float(x) for x in random.normal(size=6).astype(np.float32)]
    rows = [(i, "abc"[i % 3], float(i * i), int(random.integers(-(2**63), 2**63 - 1)), vector()) for i in range(40)]
    same = vector()
    rows += [(50, "alone", 1.5, -1, vector()), (60, "bare", None, None, None), (61, "bare", 2.0, None, [0.0] * 6), (62, "bare", None, 5, vector())]
    rows += [(70 + i, "equal", 3.0, -2, same) for i in range(9)] + [(90, None, 1.0, 1, vector()), (91, "", 0.1, 0, None), (92, "", 0.3004, -1, None)]
    links = [(0, 3, "burst"), (3, 6, "burst"), (0, 9, "bracket_candidate"), (1, 2, "near_duplicate"), (50, 999, "burst"), (91, 92, "near_duplicate")]
    found = facts.group_facts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(links, "a long, b long, kind string")).collect()
    want = loop(rows, links)
    assert len(found) == len(want)
    for r in found:
        for got, right in zip(tuple(r)[1:], want[r["group"]], strict=True):
            assert got == right if got is None or isinstance(got, list) else got == pytest.approx(right, abs=1e-6), r


def test_no_groups(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert facts.group_facts(none, spark.createDataFrame([], "a long, b long, kind string")).count() == 0


REPLIES = [
    ('```json\n[["a","b"],[]]\n```', [["a", "b"]]),
    ('```[["a","b"]]``` and more', [["a", "b"]]),
    ('So: [["a]"," b\\"[ "," "],["c"],"x",{"k":["a","b"]},[1,"d","e"]] and ] more', [["a]", 'b"['], ["d", "e"]]),
    ('[["a","b"],null,["c","d"],[],[],["e","f"]]', [["a", "b"], ["c", "d"]]),
    ("[]", []),
    ('[["a","b"]', None),
    ('[["a",b]]', None),
    ("{} none", None),
    ("", None),
    (None, None),
    ("``` x", None),
    ("[" + ",".join(['["p","q"]'] * 5) + "]" + "x" * 5000, [["p", "q"]] * 5),
]


def test_replies(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    assert [r[0] for r in rows.orderBy("i").select(parsing.reply_groups(F.col("reply"), F.lit(5))).collect()] == [w for _, w in REPLIES]


def test_validated(spark):
    words = [(i, ["w", str(i)] if i % 3 else ["w"]) for i in range(32)]
    candidates = spark.createDataFrame([("x", i, m) for i, m in words], "list string, position int, members array<string>")
    told = spark.createDataFrame([("x", 0, '[["k","l"]]'), ("x", 1, "no"), ("y", 0, "[]")], "list string, chunk int, reply string")
    found = [(r.chunk, r.n, r.members, r.confirmed) for r in replies.validated(candidates, told).orderBy("chunk", "n").collect()]
    raw = lambda c: [m for i, m in words if i // 15 == c and len(m) > 1]
    assert found == [(0, 0, ["k", "l"], True)] + [(c, n, m, False) for c in (1, 2) for n, m in enumerate(raw(c))]
    assert replies.validated(candidates.limit(0), told).count() == 0


def test_taxa(spark):
    taxa = [
        ("Rosa", "alpina Hudson ex Withering, 1801", "alpina"), ("Lissa", "Trigonotarbus schucherti", "schucherti"), ("Rosa", "x-notata", "x-notata"), ("Rosa", " alba\tvar. b", "alba"),
        ("Rosa", "sp. BOLD:1", None), ("Rosa", "Cf. alba", None), ("Rosa", "Foo Bar", None), ("Rosa", "", None), ("Rosa", None, None), ("unclassified X", "alba", None), ("R", "alba", None), (None, "alba", None),
    ]
    found = taxonomy.cleaned(spark.createDataFrame([(i, g, s) for i, (g, s, _) in enumerate(taxa)], "i int, genus string, species string"))
    assert {r.i: r.species for r in found.collect()} == {i: w for i, (*_, w) in enumerate(taxa) if w}


def test_tasks_and_scenes(spark):
    texts = {'["a","b"]': ["a", "b"], '["a",1]': ['["a"', "1]"], "a, b ,c": ["a", "b", "c"], "": ["embeddings"], None: ["embeddings"], "[a,b": ["[a", "b"], "[]": []}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.k for r in rows.select("t", parsing.tasks(F.col("t")).alias("k")).collect()} == texts
    images = spark.createDataFrame([(1, [0.3, 0.0]), (2, [0.1, 9.0]), (3, [0.22, 0.219]), (4, None)], "i int, v array<double>")
    tags = {r.i: r.t for r in images.select("i", style.scene_tags(F.col("v"), [[5.0, 0.0], [0.0, 0.5]]).alias("t")).collect()}
    assert tags == {1: ["scene_portrait"], 2: ["scene_landscape"], 3: ["scene_portrait"], 4: []}

"""Near pairs where all parts meet and by cells, and what they connect without the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import components, pairs


def vectors(n, dim):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim))
    x[:12] = x[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("moved, wider", [(0, 1), (10**9, 1), (10**9, 32)])
def test_near_pairs_by_cells_and_all_to_all(spark, monkeypatch, moved, wider):
    monkeypatch.setattr(pairs, "MOVED", moved)
    monkeypatch.setattr(pairs, "WIDER", wider)
    x = vectors(140, 6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    near = {(i, k) for i in range(140) for k in range(i + 1, 140) if 1 - x[i] @ x[k] <= 0.3}
    got = [(r.a, r.b) for r in pairs.near_pairs(rows, 0.3, block=9).collect()]
    assert sorted(got) == sorted(near)
    got = [(r.a, r.b) for r in pairs.near_pairs(rows, 0.3, block=9, asks=F.col("id") % 7 == 2).collect()]
    assert sorted(got) == sorted((i, k) for i, k in near if i % 7 == 2 or k % 7 == 2)
    links = pairs.near_links(rows, 0.3, block=9)
    degrees = {r.a: r.n for r in links.groupBy("a").agg(F.sum("n").alias("n")).collect()}
    assert degrees == {i: n for i in range(140) if (n := sum(i in p for p in near))}
    roots = [{(r.node, r.root) for r in components.components(some).collect()} for some in (links.select("a", "b"), spark.createDataFrame(list(near), "a long, b long"))]
    assert roots[0] == roots[1]


def test_vectors_that_rule_out_nothing_move_little(spark):
    """Random vectors in many dimensions: by cells, each point would go to a quarter of all cells at least."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(3000, 32))], "id long, vector array<double>")
    _, dealt = pairs._met(rows, 0.7, "id", "vector", None, pairs.BLOCK, pairs.PIVOTS)
    assert dealt.count() == 4 * 3000

"""Near pairs of vectors and hashes against all pairs, and how many are compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import components, pairs


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(rng, n, groups, dim, spread):
    centers = unit(rng.normal(size=(groups, dim)))
    return unit(centers[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)) / np.sqrt(dim))


def brute(x, cosine, asks=None):
    d = np.clip(1 - x @ x.T, 0, 2)
    near = {(i, j) for i, j in zip(*np.nonzero(d <= cosine), strict=True) if i < j}
    return near if asks is None else {(i, j) for i, j in near if asks[i] or asks[j]}


def frame(spark, x, ids=None):
    return spark.createDataFrame([((ids[i] if ids else i), v.tolist()) for i, v in enumerate(x)], f"id {'string' if ids else 'int'}, vector array<double>")


@pytest.mark.parametrize("block", [7, 1024])
@pytest.mark.parametrize("cosine", [0.0001, 0.02, 0.7, 2.0])
def test_near_pairs(spark, block, cosine):
    x = clustered(np.random.default_rng(1), 150, 12, 16, 0.3)
    x[:20] = x[0]  # a crowd of equal vectors
    got = pairs.near_pairs(frame(spark, x), cosine, block=block).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == brute(x, cosine + 1e-12)
    assert all(abs(r.distance - max(0, 1 - x[r.a] @ x[r.b])) < 1e-12 for r in got)
    asked = pairs.near_pairs(frame(spark, x), cosine, block=block, asks=F.col("id") % 10 == 3).collect()
    assert len(asked) == len({(r.a, r.b) for r in asked}) and {(r.a, r.b) for r in asked} == brute(x, cosine + 1e-12, np.arange(150) % 10 == 3)


def test_near_pairs_of_few_and_odd_rows(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [0.0, 1.0])], "id string, vector array<float>")
    assert [tuple(r) for r in pairs.near_pairs(rows, 0.1).collect()] == [("a", "b", 0.0)]
    assert pairs.near_pairs(rows.limit(0), 0.1).collect() == []


def test_few_pairs_are_compared_where_vectors_cluster(spark):
    x = clustered(np.random.default_rng(2), 3000, 60, 32, 0.25)
    rows = frame(spark, x).select("id", F.col("vector").alias("v"), F.lit(True).alias("asks"))
    compared = pairs.comparisons(pairs.cells_of(rows, 0.05))
    assert len(brute(x, 0.05)) < compared < 0.1 * 3000 * 2999 / 2
    assert {(r.a, r.b) for r in pairs.near_pairs(frame(spark, x), 0.05).collect()} == brute(x, 0.05)


@pytest.mark.parametrize("bits", [0, 2, 3, 10, 15, 20])
def test_hash_pairs(spark, bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12).astype(object)
    hashes = [int(base[i % 12]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for i in range(90)] + [int(base[0])] * 6 + [None]
    signed = [h if h is None or h < 2**63 else h - 2**64 for h in hashes]
    rows = spark.createDataFrame([(i, h, i % 2, i % 5 == 0) for i, h in enumerate(signed)], "id int, hash long, shoot int, undated boolean")
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(96) for j in range(i + 1, 96) if (hashes[i] ^ hashes[j]).bit_count() <= bits}
    got = [tuple(r) for r in pairs.hash_pairs(rows, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in pairs.hash_pairs(rows, bits, scope="shoot", asks=F.col("undated")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j, n) for i, j, n in want if i % 2 == j % 2 and (i % 5 == 0 or j % 5 == 0)}


def test_components_with_hubs(spark):
    rng = np.random.default_rng(4)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (301, 300)] + [(int(a), int(b)) for a, b in rng.integers(600, 700, (60, 2))]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    frame_ = spark.createDataFrame(edges, "a long, b long")
    got = [(r.node, r.root) for r in components.components(frame_).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)
    assert components.components(frame_.limit(0)).collect() == []

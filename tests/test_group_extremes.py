"""The nearest and furthest hashes of large groups, looked up by blocks of bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import facts


@pytest.mark.parametrize("joined", [4, 0.01])
def test_extreme_bits_of_large_groups(spark, monkeypatch, joined):
    """By look-ups as far as they are cheap, and by all pairs: groups of random hashes, of hashes in few bits, of near ones and
    of opposites, and one with a hash twice."""
    monkeypatch.setattr(facts, "SEARCHED", 20)
    monkeypatch.setattr(facts, "JOINED", joined)
    rng = np.random.default_rng(5)
    groups = {
        0: [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 150)],
        1: [int(x) for x in rng.permutation(4096)[:200]],
        2: [int(x) for x in rng.integers(0, 2**16, 90) * 2**40],
        3: [5, ~5, *(int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60))],
        4: [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 5)],
    }
    groups[2].append(groups[2][0])
    rows = [(g, h) for g, hashes in groups.items() for h in hashes]
    counted = spark.createDataFrame(rows, "group_no long, hash long").groupBy("group_no", "hash").agg(F.count("*").alias("n"))
    got = {r.group_no: (r.fewest_bits, r.most_bits) for r in facts._bits(counted, 16, 64).collect()}
    for g, hashes in groups.items():
        x = np.array(hashes).view(np.uint64)
        bits = np.bitwise_count(x[:, None] ^ x[None])[np.triu_indices(len(x), 1)]
        assert got[g] == (bits.min(), bits.max()), g


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """20,000 members with three different vectors: three values meet, not 200 million pairs."""
    seen = []
    whole = facts.extremes
    monkeypatch.setattr(facts, "extremes", lambda v: seen.append(v.count()) or whole(v))
    n = F.col("id")
    frames = spark.range(20_000).select("id", F.lit("g").alias("group"), F.lit(0.0).alias("time"), F.lit(None).cast("long").alias("hash"), F.array(F.lit(1.0), (n % 3).cast("double")).alias("vector"))
    r = facts.group_facts(frames, spark.createDataFrame([], "a long, b long, kind string")).first()
    assert seen == [3] and (r.size, r.n_distances) == (20_000, 199_990_000)
    assert r.nearest == pytest.approx(0, abs=1e-9) and r.furthest == pytest.approx(1 - 1 / np.sqrt(5))

"""Near hashes by variants of blocks and by comparing parts: the same pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import pairs


@pytest.mark.parametrize("variant, part", [(0, 32768), (10**9, 7), (10**9, 32768)])
def test_hash_pairs_both_ways(spark, monkeypatch, variant, part):
    monkeypatch.setattr(pairs, "VARIANT", variant)
    monkeypatch.setattr(pairs, "HASH_PART", part)
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 6)
    hashes = [int(np.int64(base[i % 6]) ^ np.int64(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)))) for i in range(120)]
    rows = spark.createDataFrame([(i, h, "ab"[i % 2] if i % 17 else None, i % 5 == 0) for i, h in enumerate(hashes)], "id long, hash long, shoot string, undated boolean")
    bits = {(i, k): ((hashes[i] ^ hashes[k]) & (1 << 64) - 1).bit_count() for i in range(120) for k in range(i + 1, 120)}
    got = [tuple(r) for r in pairs.hash_pairs(rows, 11).collect()]
    assert sorted(got) == sorted((i, k, n) for (i, k), n in bits.items() if n <= 11)
    got = [tuple(r) for r in pairs.hash_pairs(rows, 11, scope="shoot", asks=F.col("undated")).collect()]
    assert sorted(got) == sorted((i, k, n) for (i, k), n in bits.items() if n <= 11 and i % 2 == k % 2 and i % 17 and k % 17 and not (i % 5 and k % 5))


def test_few_hashes_make_no_variants(spark):
    """A few thousand hashes in a wide radius would have 2788 variants each; comparing all of them is cheaper."""
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("hash"), F.lit(0).alias("scope"), F.lit(True).alias("asks"))
    near = pairs.near_hashes(pairs.different_hashes(rows), 15)
    assert "Generate explode(concat(transform" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert near.filter("bits > 15 OR x >= y").isEmpty()

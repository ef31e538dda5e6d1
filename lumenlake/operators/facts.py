"""Facts of groups: times, kinds of edges, and how far apart members are, without making pairs.

Means over all pairs come from sums: the squared length of the sum of unit vectors is the sum of all cosines, and a bit that
c of n hashes have set differs in c(n - c) pairs. The nearest and the furthest pair do need comparisons, but equal values
only one: different values are dealt into parts of a bounded size, each two parts of a group meet in a task of their own,
and are compared there as matrices. Small groups share tasks. A task sends one row for each group that it saw. Where a
group has many hashes, the nearest are looked up by blocks of bits, in growing radii; so are the furthest, as what is nearest
to the complement."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.scalar import round_even
from lumenlake.functions.vector import norm, normalized
from lumenlake.plans.lineage import materialized

#: Vectors of a part, and values of small groups in a task, about; a part of hashes is HASHES times as large.
PART, SHARED, HASHES = 1024, 32768, 16
#: Different hashes of a group from which on they are looked up; how many pairs of parts cost as much as one that meets by a block.
SEARCHED, JOINED = 16384, 4


def _pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def mean_distances(vectors: DataFrame) -> DataFrame:
    """(group_no, n_distances, mean_distance) of vectors(group_no, unit, n): over pairs, n of each."""
    places = vectors.select("group_no", "n", F.posexplode("unit").alias("place", "x")).groupBy("group_no", "place").agg(F.sum(F.col("x") * F.col("n")).alias("total"))
    length = places.groupBy("group_no").agg(F.sum(F.col("total") * F.col("total")).alias("squared"))
    n = F.col("n")
    # |sum|² counts each vector with itself, which is 1, and each pair twice.
    return vectors.groupBy("group_no").agg(F.sum("n").alias("n")).join(length, "group_no").select(
        "group_no", _pairs_of(n).cast("long").alias("n_distances"), F.when(n > 1, 1 - (F.col("squared") - n) / (n * (n - 1))).alias("mean_distance")
    )


def mean_bits(hashes: DataFrame) -> DataFrame:
    """(group_no, n_hash_distances, mean_bits) of hashes(group_no, hash, n): over pairs, n of each."""
    set_in = [F.sum(F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(1)) * F.col("n")).alias(f"b{i}") for i in range(64)]
    n, total = F.col("n"), sum((F.col(f"b{i}") * (F.col("n") - F.col(f"b{i}")) for i in range(1, 64)), F.col("b0") * (F.col("n") - F.col("b0")))
    found = hashes.groupBy("group_no").agg(*set_in, F.sum("n").alias("n"))
    return found.select("group_no", _pairs_of(n).cast("long").alias("n_hash_distances"), F.when(n > 1, total / _pairs_of(n)).alias("mean_bits"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 - np.clip(x @ y.T, -1, 1)


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :])


def _extremes(left: np.ndarray, right: np.ndarray, many: np.ndarray, same: bool, apart: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple:
    """The least and the greatest distance of `left` and `right`, in tiles; `same`: of one part, whose values are pairs with
    themselves where there are `many` of them."""
    low, high = [], []
    for i in range(0, len(left), 256):
        for k in range(i if same else 0, len(right), 2048):
            found = apart(left[i : i + 256], right[k : k + 2048])
            if same and i + 256 > k:
                rows, columns = np.arange(i, i + found.shape[0])[:, None], np.arange(k, k + found.shape[1])[None, :]
                found = found[(rows < columns) | (rows == columns) & many[i : i + 256][:, None]]
            if found.size:
                low.append(found.min())
                high.append(found.max())
    return (min(low).item(), max(high).item()) if low else (None, None)


def _compared(values: DataFrame, value: str, names: tuple[str, str], kind: str, part: int, shared: int) -> DataFrame:
    """(group_no, least, greatest) of values(group_no, value, n), different in a group: over all pairs, part by part."""
    sizes = values.groupBy("group_no").agg(F.count("*").alias("size"))
    bins = max(1, -(-values.count() // shared))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / part)).cast("int")
    dealt = values.join(sizes, "group_no").filter("size > 1 OR n > 1").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(value), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = F.col("parts") > 1
    keyed = met.select(
        F.when(apart, F.col("group_no")).otherwise(F.lit(-1)).alias("alone"), F.when(apart, F.lit(-1)).otherwise(F.pmod(F.xxhash64("group_no"), F.lit(bins))).alias("bin"),
        F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "group_no", F.col(value).alias("value"), (F.col("n") > 1).alias("many"),
    )
    vectors = value == "unit"

    def compare(rows: pa.Table) -> pa.Table:
        told = rows.column("value").combine_chunks()
        held = told.flatten().to_numpy(zero_copy_only=False).reshape(len(told), -1) if vectors else told.to_numpy(zero_copy_only=False).view(np.uint64)
        many = rows["many"].to_numpy()
        p, q, own, group = rows["p"][0].as_py(), rows["q"][0].as_py(), rows["own"].to_numpy(), rows["group_no"].to_numpy()
        order = np.argsort(group, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            left, right = (at, at) if p == q else (at[own[at] == p], at[own[at] == q])
            out.append((group[at[0]].item(), *_extremes(held[left], held[right], many[left], p == q, _distances if vectors else _bits_apart)))
        kinds = [pa.int64(), *[pa.float64() if vectors else pa.int32()] * 2]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["group_no", *names])

    found = keyed.groupBy("alone", "bin", "p", "q").applyInArrow(compare, f"group_no long, {names[0]} {kind}, {names[1]} {kind}")
    return found.groupBy("group_no").agg(F.min(names[0]).alias(names[0]), F.max(names[1]).alias(names[1]))


def _dealt(hashes: DataFrame, n: int, opposite: bool) -> DataFrame:
    """(group_no, size, hash, varied, at, key, first) of hashes(group_no, size, hash, varied), for n blocks of the bits that vary:
    hashes of one key have the same block or, if asked for what is `opposite`, one of two opposite blocks, of which `first`
    is one. Bits take turns, so those that stand together are dealt out."""
    masks = [sum(1 << p for p in range(i, 64, n)) for i in range(n)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(m - (1 << 64) if m >> 63 else m).bitwiseAND(F.col("varied")).alias("mask")) for i, m in enumerate(masks))))
    cut = hashes.select("*", each.alias("k")).select("group_no", "size", "hash", "varied", "k.at", "k.mask")
    block, other = F.col("hash").bitwiseAND(F.col("mask")), F.bitwise_not("hash").bitwiseAND(F.col("mask"))
    key, first = (F.least(block, other), block <= other) if opposite else (block, F.lit(True))
    # A block without a bit that varies is its own opposite.
    return cut.select("group_no", "size", "hash", "varied", "at", key.alias("key"), first.alias("first"), (F.col("mask") == 0).alias("same"))


def _nearest(x: np.ndarray, key: np.ndarray, first: np.ndarray, opposite: np.uint64 | None) -> int | None:
    """The least number of differing bits of two hashes of one key: of two that are first, or of one that is and the complement
    of one that isn't, in the bits `opposite`."""
    order = np.lexsort((~first, key))
    x, key, first = x[order], key[order], first[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    cuts = starts + np.add.reduceat(first.astype(np.int64), starts)
    left = cuts - starts if opposite is not None else sizes
    right = sizes - left if opposite is not None else sizes
    base = cuts if opposite is not None else starts
    y = x if opposite is None else ~x & opposite
    best = []

    def take(found: np.ndarray) -> None:
        if found.size:
            best.append(found.min().item())

    met = left * right
    for k in np.flatnonzero(met >= 1 << 14):
        for i in range(starts[k], starts[k] + left[k], 256):
            for j in range(base[k] if opposite is not None else i, base[k] + right[k], 2048):
                rows, columns = x[i : min(i + 256, starts[k] + left[k])], y[j : min(j + 2048, base[k] + right[k])]
                found = _bits_apart(rows if opposite is None else rows & opposite, columns)
                if opposite is None and j < i + 256:
                    found = found[np.arange(i, i + len(rows))[:, None] < np.arange(j, j + len(columns))[None, :]]
                take(found)
    small = np.flatnonzero((met > 0) & (met < 1 << 14))
    for some in np.array_split(small, max(1, int(met[small].sum()) >> 20)):
        of = np.repeat(some, met[some])
        n = np.arange(len(of)) - np.repeat(np.cumsum(met[some]) - met[some], met[some])
        i, j = starts[of] + n // right[of], base[of] + n % right[of]
        if opposite is None:
            i, j = i[i < j], j[i < j]
        take(np.bitwise_count((x[i] if opposite is None else x[i] & opposite) ^ y[j]))
    return min(best, default=None)


def _within(r: int, opposite: bool) -> Callable[[pa.Table], pa.Table]:
    """The least number of bits among the hashes of one group and bin, if it is r or less."""

    def nearest(rows: pa.Table) -> pa.Table:
        x, varied = (rows[c].to_numpy().view(np.uint64) for c in ("hash", "varied"))
        bits = _nearest(x, rows["key"].to_numpy(), rows["first"].to_numpy(), varied[0] if opposite else None)
        return pa.table([rows["group_no"].slice(0, 1).combine_chunks(), pa.array([bits if bits is not None and bits <= r else None], pa.int32())], names=["group_no", "bits"])

    return nearest


def _looked_up(hashes: DataFrame, opposite: bool) -> tuple[DataFrame, DataFrame]:
    """(group_no, bits): the least number of bits in which two of hashes(group_no, size, hash, varied), different in a group,
    differ, or differ from being `opposite`; and the group_no for which comparing all pairs is cheaper.

    Of r + 1 blocks of bits, one is equal in two hashes that differ in r bits. So what meets by a block has the nearest pair
    in it, if that is no further than r; the radius grows until it is."""
    none = hashes.limit(0).select("group_no")
    open_, found, costly = hashes.select("group_no", "size").distinct(), [], []
    for r in range(0 if opposite else 1, 64):
        open_ = materialized(open_, "open")
        if open_.isEmpty():
            break
        dealt = _dealt(hashes.join(F.broadcast(open_.select("group_no")), "group_no"), r + 1, opposite)
        n, first = F.count("*").cast("double"), F.count_if("first").cast("double")
        met = F.when(F.max("same"), n * n).when(F.lit(opposite), 2 * first * (n - first)).otherwise(n * n)
        cost = dealt.groupBy("group_no", "at", "key").agg(met.alias("met"), F.max("size").alias("size")).groupBy("group_no").agg(F.sum("met").alias("met"), F.max("size").cast("double").alias("size"))
        cost = materialized(cost.select("group_no", "size", (F.col("met") * JOINED < F.col("size") * F.col("size")).alias("cheap")), "cost")
        costly.append(cost.filter("NOT cheap").select("group_no"))
        bins = F.ceil(F.col("size") / SHARED).cast("int")
        kept = dealt.join(F.broadcast(cost.filter("cheap").select("group_no")), "group_no").select("group_no", "at", F.pmod(F.xxhash64("key"), bins).alias("bin"), "hash", "varied", "key", "first")

        near = kept.groupBy("group_no", "at", "bin").applyInArrow(_within(r, opposite), "group_no long, bits int").groupBy("group_no").agg(F.min("bits").alias("bits"))
        found.append(materialized(near.filter("bits IS NOT NULL"), "looked-up"))
        open_ = cost.filter("cheap").join(found[-1], "group_no", "left_anti").select("group_no", "size")
    return reduce(DataFrame.unionByName, found, none.withColumn("bits", F.lit(0))), reduce(DataFrame.unionByName, costly, none)


def _bits(hashes: DataFrame, part: int, shared: int) -> DataFrame:
    """(group_no, fewest_bits, most_bits) of hashes(group_no, hash, n)."""
    facts = hashes.groupBy("group_no").agg(F.count("*").alias("size"), (F.max("n") > 1).alias("twice"), F.bit_or("hash").bitwiseXOR(F.bit_and("hash")).alias("varied"))
    large = materialized(facts.filter(F.col("size") > SEARCHED), "large-groups")
    names = ("fewest_bits", "most_bits")
    if large.isEmpty():
        return _compared(hashes, "hash", names, "int", part, shared)
    few = hashes.join(large, "group_no", "left_anti")
    rest = hashes.join(large, "group_no").select("group_no", "size", "hash", "varied", "twice")
    least, unfound = _looked_up(rest.filter("NOT twice").drop("twice"), False)
    equal = large.filter("twice").select("group_no", F.lit(0).alias("bits"))
    # Only bits that vary count, so the furthest hash is the one nearest to the complement.
    most, unseen = _looked_up(rest.drop("twice"), True)
    costly = unfound.unionByName(unseen).distinct()
    whole = _compared(few.unionByName(hashes.join(costly, "group_no", "left_semi")), "hash", names, "int", part, shared)
    out = [
        whole,
        least.unionByName(equal).select("group_no", F.col("bits").alias(names[0]), F.lit(None).cast("int").alias(names[1])),
        most.join(large, "group_no").select("group_no", F.lit(None).cast("int").alias(names[0]), (F.bit_count("varied") - F.col("bits")).alias(names[1])),
    ]
    return reduce(DataFrame.unionByName, out).groupBy("group_no").agg(F.min(names[0]).alias(names[0]), F.max(names[1]).alias(names[1]))


def extremes(values: DataFrame, part: int = PART, shared: int = SHARED) -> DataFrame:
    """(group_no, nearest, furthest, fewest_bits, most_bits) over pairs of values(group_no, unit, hash, n): n members of a
    group with one vector, or with one hash."""
    vectors, hashes = values.filter("unit IS NOT NULL"), values.filter("hash IS NOT NULL")
    near = _compared(vectors, "unit", ("nearest", "furthest"), "double", part, shared)
    return near.join(_bits(hashes, HASHES * part, shared), "group_no", "full")


def group_facts(frames: DataFrame, links: DataFrame) -> DataFrame:
    """(group, size, first, last, span, edge_types, n_distances, mean_distance, nearest, furthest, n_hash_distances, mean_bits,
    fewest_bits, most_bits) of frames(id, group, time, hash, vector) and links(a, b, kind).

    Times are of dated members; a span needs two of them, otherwise it is 0. Edge types are those of links within the group, in
    order. A vector of zeros is none, and a member without vector or hash has no distances; where fewer than two have
    them there are none: 0 pairs, and null. An id is one member, in one group; rows without a group have no facts. Vectors
    are of one length, and free of NaN."""
    rows = frames.filter("group IS NOT NULL").select("id", "group", "time", "hash", "vector")
    names = rows.select("group").distinct()
    # Written numbers stand in for names, which may be of any type.
    numbered = materialized(names.withColumn("group_no", F.monotonically_increasing_id()), "group-numbers")
    members = materialized(rows.join(numbered, "group").select("id", "group_no", "time", "hash"), "members")
    times = members.groupBy("group_no").agg(F.count("*").alias("size"), F.min("time").alias("first"), F.max("time").alias("last"))
    # Equal vectors are counted before anything is taken from them.
    counted = rows.filter("vector IS NOT NULL").join(numbered, "group").groupBy("group_no", "vector").agg(F.count("*").alias("n")).filter(norm(F.col("vector")) > 0)
    vectors = materialized(counted.select("group_no", normalized(F.col("vector")).alias("unit"), F.lit(None).cast("long").alias("hash"), "n"), "vectors")
    hashes = members.filter("hash IS NOT NULL").groupBy("group_no", F.col("hash").cast("long").alias("hash")).agg(F.count("*").alias("n"))
    hashes = materialized(hashes.select("group_no", F.lit(None).cast("array<double>").alias("unit"), "hash", "n"), "hashes")
    a, b = (members.select(F.col("id").alias(c), F.col("group_no").alias(f"group_{c}")) for c in "ab")
    inner = links.select("a", "b", "kind").join(a, "a").join(b, "b").filter("group_a = group_b")
    kinds = inner.groupBy(F.col("group_a").alias("group_no")).agg(F.sort_array(F.collect_set("kind")).alias("edge_types"))
    out = numbered.join(times, "group_no")
    for more in (kinds, mean_distances(vectors), mean_bits(hashes), extremes(vectors.unionByName(hashes))):
        out = out.join(more, "group_no", "left")
    span = F.coalesce(round_even(F.col("last") - F.col("first"), 3), F.lit(0.0))
    return out.select(
        "group", "size", "first", "last", span.alias("span"), F.coalesce("edge_types", F.array().cast("array<string>")).alias("edge_types"),
        F.coalesce("n_distances", F.lit(0)).alias("n_distances"), "mean_distance", "nearest", "furthest",
        F.coalesce("n_hash_distances", F.lit(0)).alias("n_hash_distances"), "mean_bits", "fewest_bits", "most_bits",
    )

"""Pairs of near rows without all pairs: unit vectors by pivots and angles, hashes by blocks of bits.

Vectors: every point belongs to the cell of its nearest pivot. Angles obey the triangle inequality, so a point within an
angle of some member of a cell is no further from the cell's pivot than that angle and the cell's radius together: it visits
those cells only. Cells are cut into parts and their visitors into chunks of a bounded size, so no task sees a large cell
whole; a part and a chunk are compared by one product of matrices.

Hashes: of the differing bits of two near hashes, some block of the hash has no more than its share. One side emits its
blocks, the other all variants of its blocks within the share; whoever meets is verified on all bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.scalar import hamming
from lumenlake.plans.lineage import materialized

#: Pivots at most, and for each as many points to choose from; points of a part or chunk, about.
PIVOTS, CHOICE, BLOCK = 512, 8, 1024
#: Parts are so much larger where all parts meet; numbers of a part at most; parts to share the work among, if points suffice. How
#: many comparisons cost as much as moving a row.
WIDER, NUMBERS, SHARES, MOVED = 32, 1 << 21, 8, 2500
#: Blocks of a hash; differing bits in a block for which variants are made at most.
HASH_BLOCKS, VARIED = 4, 3
#: How many pairs of hashes compared in a task cost as much as one variant, which is written, sorted and joined.
VARIANT = 1000
#: Hashes of a part where all parts are compared.
HASH_PART = 32768


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length, as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


@dataclass
class Cells:
    """Pivots, and for each cell its radius, members and visitors; `reach` is the angle of near pairs."""

    pivots: np.ndarray
    radii: np.ndarray
    members: np.ndarray
    visitors: np.ndarray
    reach: float

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vectors @ self.pivots.T, -1, 1))

    def visits(self, angles: np.ndarray, own: np.ndarray, all_ask: bool) -> np.ndarray:
        """Which cells a point visits; where all ask, only its own and later ones, since the others come to it."""
        near = angles <= self.radii + self.reach
        return near & (np.arange(len(self.radii)) >= own[:, None]) if all_ask else near


def _counted(points: DataFrame, cells: Cells, all_ask: bool, radii: bool) -> np.ndarray:
    """By cell: members and the largest angle (`radii`), or visitors. Each task sends a row for each cell at most."""
    held = points.sparkSession.sparkContext.broadcast(cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        n, most = np.zeros(len(c.radii), np.int64), np.zeros(len(c.radii))
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = c.angles(matrix(batch.column("v")))
            own = angles.argmin(axis=1)
            if radii:
                n += np.bincount(own, minlength=len(n))
                np.maximum.at(most, own, angles[np.arange(len(own)), own])
            else:
                asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                n += c.visits(angles, own, all_ask)[asks].sum(axis=0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(most[met])], ["cell", "n", "most"])

    found = points.mapInArrow(count, "cell long, n long, most double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("most").alias("most")).toArrow()
    out = np.zeros((2, len(cells.radii)))
    out[:, found["cell"].to_numpy()] = found["n"].to_numpy(), found["most"].to_numpy()
    return out


def cells_of(points: DataFrame, cosine: float, all_ask: bool = True, pivots: int = PIVOTS) -> Cells | None:
    """The cells of points(id, v, asks); None without points. Of a bounded choice of points, the first by a hash of their
    ids, pivots are those that lie furthest from the pivots before them, so each cluster gets its own."""
    k = max(1, min(pivots, 2 * math.isqrt(points.count())))
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(CHOICE * k).select("v").toArrow()  # CHOICE * `pivots` rows at most
    if not chosen.num_rows:
        return None
    some = matrix(chosen["v"])
    some /= np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-300)
    picked, nearest = [0], some @ some[0]
    while len(picked) < k and nearest.min() < 1 - 1e-9:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, some @ some[picked[-1]])
    unit = some[picked]
    none = np.zeros(len(unit))
    cells = Cells(unit, none, none, none, math.acos(max(-1.0, 1 - cosine)) + 1e-6)
    cells.members, cells.radii = _counted(points, cells, all_ask, True)
    cells.radii[cells.members == 0] = -math.inf
    cells.visitors = _counted(points, cells, all_ask, False)[0]
    return cells


def comparisons(cells: Cells | None) -> int:
    """How many pairs are compared."""
    return 0 if cells is None else int((cells.members * cells.visitors).sum())


def _dealt(points: DataFrame, cells: Cells, all_ask: bool, block: int) -> DataFrame:
    """(cell, part, chunk, home, own, asks, id, v): every point in its part, for each chunk of the cell's visitors, and as a
    visitor in a chunk of each cell that it visits, for each of the cell's parts."""
    parts, chunks = (np.maximum(1, -(-n // block)).astype(np.int64) for n in (cells.members, cells.visitors))
    held = points.sparkSession.sparkContext.broadcast((cells, parts, chunks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, parts, chunks = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                angles = c.angles(matrix(rows.column("v")))
                own, mark = angles.argmin(axis=1), rows.column("mark").to_numpy().view(np.uint64)
                asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                index = np.repeat(np.arange(len(own)), np.where(c.visitors[own] > 0, chunks[own], 0))
                first = np.concatenate([[0], np.cumsum(np.where(c.visitors[own] > 0, chunks[own], 0))])[:-1]
                home = (index, own[index], (mark % parts[own].astype(np.uint64)).astype(np.int64)[index], np.arange(len(index)) - first[index])
                i, cell = np.nonzero(c.visits(angles, own, all_ask) & asks[:, None])
                index = np.repeat(np.arange(len(i)), parts[cell])
                first = np.concatenate([[0], np.cumsum(parts[cell])])[:-1]
                guest = (i[index], cell[index], np.arange(len(index)) - first[index], ((mark[i] >> np.uint64(20)) % chunks[cell].astype(np.uint64)).astype(np.int64)[index])
                for (rows_of, cells_of_, part, chunk), at_home in ((home, True), (guest, False)):
                    if len(rows_of):
                        took = rows.take(pa.array(rows_of))
                        n = len(rows_of)
                        columns = [pa.array(cells_of_), pa.array(part), pa.array(chunk), pa.array(np.full(n, at_home)), pa.array(own[rows_of] == cells_of_), took.column("asks"), took.column("id"), took.column("v")]
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "part", "chunk", "home", "own", "asks", "id", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.mapInArrow(deal, f"cell long, part long, chunk long, home boolean, own boolean, asks boolean, id {kinds['id']}, v {kinds['v']}")


def _dealt_to_all(points: DataFrame, parts: int, chunks: int, all_ask: bool) -> DataFrame:
    """The same columns where nothing is ruled out: all parts meet, or if not all ask, each part and each chunk of those that do."""
    mark = F.col("mark")
    own, kept = F.pmod(mark, F.lit(parts)), [F.col(c) for c in ("asks", "id", "v")]
    cell, true, false = F.lit(0).cast("long").alias("cell"), F.lit(True), F.lit(False)
    if all_ask:
        # A part is at home with itself, where it is a visitor too, and with later parts.
        met = points.select("*", own.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts).cast("long"))).alias("other"))
        same = F.col("other") == parts
        other = F.when(same, F.col("part")).otherwise(F.col("other"))
        return met.select(cell, F.least("part", other).alias("part"), F.greatest("part", other).alias("chunk"), (~same & (F.col("part") <= F.col("other"))).alias("home"), (other == F.col("part")).alias("own"), *kept)
    home = points.select(cell, own.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), true.alias("home"), true.alias("own"), *kept)
    guest = points.filter("asks").select(cell, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(mark, F.lit(chunks)).alias("chunk"), false.alias("home"), true.alias("own"), *kept)
    return home.unionByName(guest)


def _met(points: DataFrame, cosine: float, id_: str, vector: str, asks: Column | None, block: int, pivots: int) -> tuple[DataFrame, DataFrame | None]:
    """points(id, v, mark, asks) as written, and dealt to tasks by cells or, where cells rule out too little for what they make
    move, all parts to all; None without points."""
    told = points.select(F.col(id_).alias("id"), F.col(vector).alias("v"), F.xxhash64(id_).alias("mark"), F.lit(True).alias("asks") if asks is None else F.coalesce(asks, F.lit(False)).alias("asks"))
    held, all_ask = materialized(told.filter("v IS NOT NULL AND size(v) > 0"), "vectors"), asks is None
    cells = cells_of(held, cosine, all_ask, pivots)
    if cells is None:
        return held, None
    n, many = int(cells.members.sum()), held.filter("asks").count()
    part = max(block, min(block * WIDER, NUMBERS // cells.pivots.shape[1], -(-n // SHARES)))
    parts, chunks = -(-n // part), max(1, -(-many // part))
    moved = (cells.members * np.ceil(cells.visitors / block)).sum() + (cells.visitors * np.ceil(cells.members / block)).sum()
    moved_to_all, compared = (n * (parts + 1), n * n / 2) if all_ask else (n * chunks + many * parts, n * many)
    if MOVED * moved_to_all + compared < MOVED * moved + comparisons(cells):
        return held, _dealt_to_all(held, parts, chunks, all_ask)
    return held, _dealt(held, cells, all_ask, block)


def _near(table: pa.Table, cosine: float, all_ask: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(visitor, at home, whether the visitor's id is smaller, distance) of the near pairs of a task, tile by tile; places are those
    in the table."""
    at_home = table["home"].to_numpy()
    guests, homes = np.flatnonzero(~at_home), np.flatnonzero(at_home)
    if not len(guests) or not len(homes):
        return
    v, ids = matrix(table["v"]), np.array(table["id"].to_pylist())
    own, asks = (table[c].to_numpy() for c in ("own", "asks"))
    # Numbers of half the length find what may be near; the distance itself is taken in doubles.
    rough, slack = v.astype(np.float32), 1e-6 + 2e-7 * v.shape[1]
    for r in range(0, len(guests), 1024):
        for c in range(0, len(homes), 2048):
            x, y = guests[r : r + 1024], homes[c : c + 2048]
            i, k = np.nonzero(rough[x] @ rough[y].T >= 1 - cosine - slack)
            i, k = x[i], y[k]
            # Each pair counts once: of two that would meet twice, where the smaller one visits.
            twice, smaller = own[i] if all_ask else asks[k], ids[i] < ids[k]
            keep = np.flatnonzero(np.where(twice, smaller, ids[i] != ids[k]))
            i, k, smaller = i[keep], k[keep], smaller[keep]
            found = np.empty(len(i))
            for at in range(0, len(i), 2048):
                found[at : at + 2048] = 1 - np.cumsum(v[i[at : at + 2048]] * v[k[at : at + 2048]], axis=1)[:, -1]
            found = np.clip(found, 0, 2)
            fits = found <= cosine
            yield i[fits], k[fits], smaller[fits], found[fits]


def near_pairs(points: DataFrame, cosine: float, *, id_: str = "id", vector: str = "vector", asks: Column | None = None, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, distance): pairs of unit vectors within a cosine distance, exactly; a < b.

    With `asks`, a condition on the rows, only pairs of which one row asks at least. Rows without a vector have no pairs;
    vectors are of one length. Distances are sums of products from left to right, in doubles, between 0 and 2."""
    kind, all_ask = points.schema[id_].dataType.simpleString(), asks is None
    held, dealt = _met(points, cosine, id_, vector, asks, block, pivots)
    if dealt is None:
        return held.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")).limit(0)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs go on tile by tile, so no task holds all that it finds."""
        table = pa.Table.from_batches(batches)
        ids = table["id"].combine_chunks()
        for i, k, smaller, found in _near(table, cosine, all_ask):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(smaller, i, k))), ids.take(pa.array(np.where(smaller, k, i))), pa.array(found)], ["a", "b", "distance"])

    return dealt.groupBy("cell", "part", "chunk").applyInArrow(compare, f"a {kind}, b {kind}, distance double")


def near_links(points: DataFrame, cosine: float, *, id_: str = "id", vector: str = "vector", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, n): what `near_pairs` connect, without the pairs. The sum of n over the rows of an a is the number of its pairs, and
    the links a to b, which may be no near pair themselves, connect what near pairs do.

    A task sends a row for each of its points at most, however many pairs it finds."""
    kind = points.schema[id_].dataType.simpleString()
    held, dealt = _met(points, cosine, id_, vector, None, block, pivots)
    if dealt is None:
        return held.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("n")).limit(0)

    def connect(table: pa.Table) -> pa.Table:
        ids = table["id"].combine_chunks()
        _, first, code = np.unique(np.array(ids.to_pylist()), return_index=True, return_inverse=True)
        root, n = np.arange(len(first)), np.zeros(len(first), np.int64)
        for i, k, _, _ in _near(table, cosine, True):
            a, b = code[i], code[k]
            n += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
            while len(a := a[apart := root[a] != root[b]]):
                b = b[apart]
                np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
                while not np.array_equal(root, root[root]):
                    root = root[root]
        some = np.flatnonzero(n)
        return pa.table({"a": ids.take(pa.array(first[some])), "b": ids.take(pa.array(first[root[some]])), "n": pa.array(n[some])})

    return dealt.groupBy("cell", "part", "chunk").applyInArrow(connect, f"a {kind}, b {kind}, n long")


def _block_masks(bits: int) -> list[int]:
    """The bits of each block of a hash for a radius, from the lowest."""
    n = min(HASH_BLOCKS, bits + 1)
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def different_hashes(rows: DataFrame) -> DataFrame:
    """(scope, hash, asks) of rows(scope, hash, asks): each hash of a scope once; it asks if some row of it does."""
    return materialized(rows.groupBy("scope", "hash").agg(F.max("asks").alias("asks")), "different-hashes")


def near_hashes(different: DataFrame, bits: int) -> DataFrame:
    """(scope, x, y, bits): pairs of different hashes of different(scope, hash, asks) of which one asks, each once; x asks.

    Variants of blocks are made where that costs less than comparing all hashes of a scope, which tasks do part by part."""
    asked, masks = different.filter("asks"), _block_masks(bits)
    share = bits // len(masks)
    variants = sum(math.comb(m.bit_count(), k) for m in masks for k in range(share + 1))
    if share > VARIED or asked.count() and different.groupBy("scope").agg((F.count("*") * F.count_if("asks")).alias("n")).agg(F.sum("n")).first()[0] < variants * VARIANT * asked.count():
        return _compared_hashes(different, bits)
    parts = F.array(*(F.struct(F.lit(i).alias("at"), F.col("hash").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(masks)))

    def varied(at: int, mask: int) -> Column:
        places = [p for p in range(64) if mask >> p & 1]
        flips = [_signed(sum(1 << p for p in c)) for n in range(share + 1) for c in combinations(places, n)]
        own = F.col("hash").bitwiseAND(F.lit(_signed(mask)))
        return F.transform(F.lit(flips), lambda f: F.struct(F.lit(at).alias("at"), own.bitwiseXOR(f).alias("block")))

    near = [varied(i, m) for i, m in enumerate(masks)]
    left = asked.select("scope", F.col("hash").alias("x"), F.explode(F.concat(*near)).alias("k")).select("scope", "x", "k.at", "k.block")
    right = different.select("scope", F.col("hash").alias("y"), "asks", F.explode(parts).alias("k")).select("scope", "y", "asks", "k.at", "k.block")
    met = left.join(right, ["scope", "at", "block"])
    # Hashes that both ask would be found from both sides.
    found = met.filter((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ~F.col("asks"))).select("scope", "x", "y", hamming(F.col("x"), F.col("y")).alias("bits"))
    return found.filter(F.col("bits") <= bits).distinct()


def _compared_hashes(different: DataFrame, bits: int) -> DataFrame:
    """`near_hashes` by comparing all: hashes are dealt into parts, each two parts of a scope meet in a task, and are compared
    there in tiles. Scopes of one part share tasks."""
    sizes = different.groupBy("scope").agg(F.count("*").alias("size"))
    bins = max(1, -(-different.count() // HASH_PART))
    parts = F.ceil(F.col("size") / HASH_PART).cast("int")
    dealt = different.join(sizes, "scope").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("hash"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart, mark = F.col("parts") > 1, F.xxhash64("scope")
    keyed = met.select(
        F.when(apart, mark).otherwise(F.pmod(mark, F.lit(bins))).alias("place"), apart.alias("apart"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "scope", "hash", "asks"
    )
    kind = different.schema["scope"].dataType.simpleString()

    def compare(rows: pa.Table) -> pa.Table:
        scopes = rows["scope"].combine_chunks()
        group = scopes.dictionary_encode().indices.to_numpy()
        own, asks, p, q = rows["own"].to_numpy(), rows["asks"].to_numpy(), rows["p"][0].as_py(), rows["q"][0].as_py()
        signed = rows["hash"].to_numpy()
        hashes, order = signed.view(np.uint64), np.argsort(group, kind="stable")
        found = [np.zeros((3, 0), np.int64)]
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            left, right = (at, at) if p == q else (at[own[at] == p], at[own[at] == q])
            for i in range(0, len(left), 256):
                for k in range(i if p == q else 0, len(right), 4096):
                    x, y = left[i : i + 256], right[k : k + 4096]
                    apart_ = np.bitwise_count(hashes[x][:, None] ^ hashes[y][None, :])
                    m, n = np.nonzero(apart_ <= bits)
                    keep = (asks[x[m]] | asks[y[n]]) & ((i + m < k + n) if p == q else True)
                    m, n = m[keep], n[keep]
                    found.append(np.stack([x[m], y[n], apart_[m, n]]).astype(np.int64))
        x, y, n = np.concatenate(found, axis=1)
        # The first one asks; where both do, it is the smaller.
        turned = np.where(asks[x] & asks[y], signed[x] > signed[y], ~asks[x])
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        return pa.table([scopes.take(pa.array(x)), pa.array(signed[x]), pa.array(signed[y]), pa.array(n, pa.int32())], names=["scope", "x", "y", "bits"])

    return keyed.groupBy("place", "apart", "p", "q").applyInArrow(compare, f"scope {kind}, x long, y long, bits int")


def hash_pairs(frames: DataFrame, bits: int, *, id_: str = "id", hash_: str = "hash", scope: str | None = None, asks: Column | None = None) -> DataFrame:
    """(a, b, bits): pairs of rows whose 64-bit hashes differ in `bits` or fewer, in one scope, exactly; a < b.

    With `asks`, a condition on the rows, only pairs of which one row asks at least. Rows without a hash have no pairs.
    Hashes meet, not rows: rows of equal hashes are told apart after the search. Where there is nothing to look up, as in a
    radius beyond a quarter of the bits, or many variants of few hashes, all hashes of a scope are compared, part by part."""
    rows = frames.select(F.col(id_).alias("id"), (F.col(scope) if scope else F.lit(0)).alias("scope"), F.col(hash_).alias("hash"), F.lit(True).alias("asks") if asks is None else F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = materialized(rows.filter("hash IS NOT NULL AND scope IS NOT NULL"), "hashes")
    near_ = materialized(near_hashes(different_hashes(rows), bits), "near-hashes")
    one = rows.select("scope", F.col("hash").alias("x"), F.col("id").alias("a"), F.col("asks").alias("asks_a"))
    two = rows.select("scope", F.col("hash").alias("y"), F.col("id").alias("b"), F.col("asks").alias("asks_b"))
    apart = near_.join(one, ["scope", "x"]).join(two, ["scope", "y"]).filter("(asks_a OR asks_b) AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")
    equal = one.join(two.withColumnRenamed("y", "x"), ["scope", "x"]).filter("a < b AND (asks_a OR asks_b)").select("a", "b", F.lit(0).alias("bits"))
    return apart.unionByName(equal)

"""Near-duplicate documents by SimHash: meet-in-the-middle ball hashing, then connected components.

Fingerprint: 64 bits over all shingles of a document, repeats included. A bit is 1 if more than half of the shingles'
XXH64 values have it. Two fingerprints link at `RADIUS` differing bits or fewer.

Search, exact, for a radius of three: of three differing bits, some block of the three below holds one at least. With
that block masked out two bits at most differ, so the balls of radius one (half of two) around both meet. Every distinct
fingerprint therefore emits, for each masked block, itself and all variants at one bit; variants are shuffled, and pairs
that collide are verified on all bits and deduplicated. Copies share a fingerprint and never meet in a bucket.

Where many distinct fingerprints crowd (`CROWD` in a bucket) no pairs are made. Members of such buckets emit whole balls
on unmasked bits: radius one as hubs, radius two as spokes, of which only pairs of bits in the same half are needed
(of three bits two lie in one half). Whoever shares a variant so is linked, so each bucket gives a star, and its size is
bounded by the ball, not by the data.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is linked like any other;
repeated rows and repeated ids are all kept, and component_id is the smallest doc_id among all documents reachable (null
only if all their ids are null). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import materialized, with_key
from lumenlake.llm.components import HOT, components, joined
from lumenlake.plans.lineage import bucketed, swept

RADIUS = 3
SEED = 42
#: Distinct fingerprints in a bucket from which on stars replace verified pairs.
CROWD = 64


def fingerprint_bits(hashes: np.ndarray) -> int:
    """The 64-bit majority of unsigned 64-bit values: a bit is set if more than half of the values have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def text_fingerprint(text: bytes, shingle: int) -> int:
    tokens = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) > shingle:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
    else:
        grams = [b" ".join(tokens)]
    return fingerprint_bits(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, *keep: str) -> DataFrame:
    """(doc_id, *keep, fp): fp holds the fingerprint's 64 bits as a signed long."""
    named = ["doc_id", *keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (text_fingerprint(t.as_py() or b"", shingle) for t in batch.column("text")), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), pa.array(found.view(np.int64))], [*named, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in named)
    return docs.select(*named, F.col("text").cast("binary").alias("text")).mapInArrow(score, f"{kinds}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(fp: Column, masks: list[int]) -> Column:
    return F.transform(F.lit([_signed(m) for m in masks]), lambda m: fp.bitwiseXOR(m))


def blocks(bits: int) -> list[int]:
    """Masks of the three blocks of a fingerprint."""
    cuts = [0, -(-bits // 3), -(-2 * bits // 3), bits]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def masked_balls(fp: Column, bits: int) -> Column:
    """For each block: the fingerprint without it, and that with any one of the other bits flipped."""
    parts = []
    for block in blocks(bits):
        flips = [0, *(1 << i for i in range(bits) if not block >> i & 1)]
        parts.append(_flips(fp.bitwiseAND(F.lit(_signed(~block & (1 << 64) - 1))), flips))
    return F.concat(*parts)


def hub_ball(fp: Column, bits: int) -> Column:
    return _flips(fp, [0, *(1 << i for i in range(bits))])


def spoke_ball(fp: Column, bits: int) -> Column:
    """Two flips within the low or within the high half of the bits."""
    halves = (range(bits // 2), range(bits // 2, bits))
    return _flips(fp, [1 << i | 1 << j for h in halves for i in h for j in h if i < j])


def links(distinct: DataFrame, crowd: int = CROWD, bits: int = 64) -> DataFrame:
    """(a, b): edges between different fingerprints with the same components as all pairs within RADIUS bits.

    Only the lowest `bits` bits of the column fp are searched; those above must be equal."""
    balls = distinct.select("fp", F.explode(masked_balls(F.col("fp"), bits)).alias("variant"))
    # A bucket's members are numbered and counted where the shuffle has brought them; none is collected whole.
    buckets = balls.selectExpr(
        "variant",
        "fp",
        "count(*) OVER (PARTITION BY variant) AS n",
        "row_number() OVER (PARTITION BY variant ORDER BY fp) AS at",
    ).filter("n > 1")
    groups = buckets.groupBy("variant", F.floor((F.col("at") - 1) / crowd).alias("part")).agg(
        (F.max("n") > crowd).alias("crowded"), F.array_sort(F.collect_set("fp")).alias("fps")
    )
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda a: F.transform(
                F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    alone = F.transform("fps", lambda a: F.struct(a.alias("a"), a.alias("b")))
    found = materialized(
        groups.select(F.explode(F.when(F.col("crowded"), alone).otherwise(pairs)).alias("p"))
        .select("p.a", "p.b")
        .distinct(),
        "simhash-links",
    )
    crowded = found.filter("a = b").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return found
    emitted = crowded.select("fp", F.explode(hub_ball(F.col("fp"), bits)).alias("variant"), F.lit(True).alias("hub")).union(
        crowded.select("fp", F.explode(spoke_ball(F.col("fp"), bits)).alias("variant"), F.lit(False).alias("hub"))
    )
    stars = (
        emitted.selectExpr("fp", "min(CASE WHEN hub THEN fp END) OVER (PARTITION BY variant) AS center")
        .filter("center <> fp")
        .select(F.least("fp", "center").alias("a"), F.greatest("fp", "center").alias("b"))
        .distinct()
    )
    return found.filter("a < b").union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text); see the module."""
    prints = materialized(fingerprints(docs, shingle), "simhash-fingerprints")
    distinct = materialized(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct"
    )  # copies meet in partial sums before the shuffle
    roots = components(links(distinct, crowd))
    # Only fingerprints that have links are regrouped; the others are components of their own.
    rooted = materialized(
        distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots"
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialized(joined(rooted, smallest, "root").select("fp", "component_id"), "simhash-named")
    return joined(prints, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """`docs`, with all columns, less all but one document of each root of groups(doc_id, text_hash, root): the smallest
    doc_id stays.

    Ids may repeat or be null: a document is named by (doc_id, text_hash), nulls last, and only the survivor's own
    repeats are reduced to one: that whose other columns, of any type, have the smallest hash as JSON."""
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("of"))
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in ("doc_id", "text"))))
    d = docs.select(F.struct(*docs.columns).alias("whole"), F.xxhash64(others).alias("order"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("d")
    f = first.alias("f")
    kept = d.join(f, F.expr("d.doc_id <=> f.of.doc_id AND d.text_hash = f.of.text_hash"), "left_semi")
    return kept.groupBy("doc_id", "text_hash").agg(F.min_by("whole", "order").alias("whole")).select("whole.*")


def one_of_each_component(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """`docs`, with all columns, less all but one document of each component of `near_duplicates`: see `_one_of_each`."""
    prints = materialized(fingerprints(with_key(docs), shingle, "text_hash"), "simhash-fingerprints")
    # Copies meet in partial sums before the shuffle; of a fingerprint only its first document can stay.
    named = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("of")
    distinct = materialized(prints.groupBy("fp").agg(named), "simhash-distinct")
    roots = components(links(distinct, crowd))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("of.doc_id", "of.text_hash", F.coalesce("root", "fp").alias("root"))
    return _one_of_each(docs, materialized(rooted, "simhash-roots"))


# What follows finds near copies by sets of five-word shingles with a Jaccard likeness of SIMILARITY or more, which
# differ in ten bits of a fingerprint, beyond any ball: the sets themselves are joined. No registered query uses it.

SIMILARITY = 0.8
#: Bits of a set's parities.
PARITIES = 1024
#: Turns in which buckets have one hub each; what these connect isn't paired.
HUBS = 4
#: Shingles that are known to be common, at most; they only order the others.
ORDERED = 1 << 17


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    tokens = text.lower().split()
    if len(tokens) > shingle:
        grams = set(map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False)))
    else:
        grams = {b" ".join(tokens)}
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)).view(np.int64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits: of how many hashes fall on each, whether it is odd. Two sets differ in as many elements at least
    as their bits do, since what both hold cancels out."""
    odd = np.bincount((hashes.view(np.uint64) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _even(a: str, b: str) -> str:
    """SQL: two sets' sizes and parities allow for SIMILARITY."""
    at_most = f"{(1 - SIMILARITY) / (1 + SIMILARITY)} * ({a}.n + {b}.n) + 1e-6"
    apart = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(PARITIES // 64))
    return f"{apart} <= {at_most}"


def _near(a: str, b: str) -> str:
    """SQL: two sets' sizes and places of a common shingle allow for SIMILARITY."""
    return (
        f"least({a}.n, {b}.n) >= {SIMILARITY} * greatest({a}.n, {b}.n) - 1e-6"
        # What both can share at most: all before the lesser place, and all from there on in the set with less left.
        f" AND least({a}.pos, {b}.pos) + least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {SIMILARITY / (1 + SIMILARITY)} * ({a}.n + {b}.n) - 1e-6"
    )


def prefix_length(n: int) -> int:
    """Sets alike by SIMILARITY share one of so many of their first shingles, in any order that all sets follow."""
    return n - math.ceil(SIMILARITY * n - 1e-9) + 1


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many texts hold, the rarest first, from a quarter of the texts: an order, which loses nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", shingle) for t in batch.column("text")]
            gram, n = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram[n > 1]), pa.array(n[n > 1])], ["gram", "n"])

    some = docs.filter(F.pmod("text_hash", F.lit(4)) == 0).select(F.col("text").cast("binary").alias("text"))
    counts = some.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "gram").limit(ORDERED).select("gram").toArrow()["gram"]
    return top.to_numpy()[::-1]


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, alike) of pairs(a, b): whether the shingle sets of texts(node, text) have SIMILARITY, exactly."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, None
        for batch in batches:
            found = []
            for b, x, y in zip(batch.column("b"), batch.column("x"), batch.column("y"), strict=True):
                if b.as_py() != node:  # joined by b last, so equal ones follow each other
                    node, held = b.as_py(), shingle_set(y.as_py(), shingle)
                own = shingle_set(x.as_py(), shingle)
                both = len(np.intersect1d(own, held, assume_unique=True))
                found.append(both >= SIMILARITY * (len(own) + len(held) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.bool_())], ["a", "b", "alike"])

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, alike boolean")


#: A node in so many stands for all where hot shingles are looked for.
_LOOKED_AT = 16


def hot_shingles(sets: DataFrame) -> DataFrame | None:
    """(gram) of sets(node, gram) that a thousandth of all rows hold, by a sample of nodes, so a few thousand at most; None
    if there are none. They are only dealt out in another way, which changes no result."""
    some = sets.filter(F.pmod(F.xxhash64("node"), F.lit(_LOOKED_AT)) == 0)
    n = some.count()
    hot = materialized(some.groupBy("gram").agg(F.count("*").alias("n")).filter((F.col("n") > n * HOT) & (F.col("n") > 1)).select("gram"), "copies-hot")
    return None if hot.isEmpty() else F.broadcast(hot)


def by_shingle(rows: DataFrame, hot: DataFrame | None, **aggregates: str) -> DataFrame:
    """`rows` with columns that hold aggregates, in SQL, of all rows of the same gram.

    Rows of hot shingles stay where they are: their aggregates are combined within tasks and broadcast."""
    over = {k: F.expr(a).over(Window.partitionBy("gram")) for k, a in aggregates.items()}
    if hot is None:
        return rows.withColumns(over)
    own = rows.join(hot, "gram", "left_semi")
    few = F.broadcast(own.groupBy("gram").agg(*(F.expr(a).alias(k) for k, a in aggregates.items())))
    return rows.join(hot, "gram", "left_anti").withColumns(over).unionByName(own.join(few, "gram"))


def copy_groups(docs: DataFrame, shingle: int = 5, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_hash, root) for every row of docs(doc_id, text): near copies, and what they connect, share a root.

    A prefix join, exact: the shingles of every set are put in one order, the rarest first; sets that are alike share a
    shingle among their first fifth, and all that do are candidates if their sizes, places and parities allow the
    likeness. Equal sets are one node. Every candidate pair is verified on the whole texts, except within what is already connected:
    in `HUBS` turns every node of a bucket is held against one of them, then all pairs whose components differ. Buckets
    of more than `crowd` nodes are cut into blocks of that size, each pair of blocks on its own."""
    keyed = with_key(docs)
    ordered = docs.sparkSession.sparkContext.broadcast(common_shingles(keyed, shingle))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = ordered.value
        sort = np.argsort(common)
        known = common[sort]
        for batch in batches:
            nodes, sizes, firsts, bits = [], [], [], []
            for t in batch.column("text"):
                own = shingle_set(t.as_py() or b"", shingle)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                rank = np.where(known[at] == own, sort[at] + 1, 0) if len(known) else np.zeros(len(own), np.int64)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                bits.append(parities(own))
                firsts.append(own[np.argsort(rank, kind="stable")[: prefix_length(len(own))]])
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            first = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), first, pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "n", "first", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = keyed.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    prints = swept(materialized(asked.mapInArrow(place, f"doc_id {kind}, text_hash long, node long, n int, first array<long>, bits array<long>"), "copies-prints"))
    ordered.destroy()
    # Copies meet in partial aggregates before the shuffle.
    once = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("doc_id", "text_hash")).alias("of"))
    sets = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first")).select("node", "n", F.posexplode("first").alias("pos", "gram"))
    hot = hot_shingles(prints.select("node", F.explode("first").alias("gram")))
    sets = sets if hot is None else materialized(sets, "copies-sets")
    held = swept(materialized(by_shingle(sets, hot, held="count(*)").filter("held > 1").drop("held"), "copies-held"))
    # One text of each node that has candidates.
    named = swept(materialized(once.join(held.select("node").distinct(), "node", "left_semi"), "copies-named"))
    d, r = asked.alias("d"), named.select("node", "of").alias("r")
    same = F.expr("d.doc_id <=> r.of.doc_id AND d.text_hash = r.of.text_hash")
    texts = d.join(r, same).select("r.node", F.coalesce("d.text", F.lit(b"")).alias("text"))
    texts = swept(bucketed(texts, "node", "copies_texts"))  # each verification shuffles pairs, not all texts
    marks = named.select("node", "n", "bits")  # joined to pairs, not to every shingle
    tried, rooted = None, held.withColumn("root", F.col("node"))
    for turn in range(HUBS):
        # Another node of each bucket in turn is its hub; a node is held against one hub of each component that it meets.
        hub = f"min(struct(xxhash64(root, {turn}) AS order, xxhash64(node, {turn}) AS turn, node, n, pos, root))"
        met = by_shingle(rooted, hot, y=hub).selectExpr("struct(node, n, pos, root) AS x", "y").filter("x.root <> y.root").filter(_near("x", "y"))
        pairs = met.select("x.node", F.col("y.node").alias("other"), "y.root", "y.turn").distinct()
        p, x, y = pairs.alias("p"), marks.alias("x"), marks.alias("y")
        even = p.join(x, F.expr("p.node = x.node")).join(y, F.expr("p.other = y.node")).filter(_even("x", "y")).select("p.*")
        hubs = even.groupBy("node", "root").agg(F.min(F.struct("turn", F.col("other").alias("node"))).alias("hub")).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        hubs = hubs.join(tried, ["a", "b"], "left_anti") if tried is not None else hubs
        found = swept(materialized(_alike(hubs, texts, shingle), "copies-hubs"))
        tried = found if tried is None else tried.union(found)
        if found.filter("alike").isEmpty():
            break
        roots = components(tried.filter("alike").select("a", "b")).withColumnRenamed("node", "own")
        rooted = held.join(roots, F.col("node") == F.col("own"), "left").select("gram", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
        rooted = materialized(rooted, "copies-rooted")
    # Nodes are dealt to a bucket's blocks by a hash, so a block has about `crowd` of them.
    cut = by_shingle(rooted, hot, low="min(root)", high="max(root)", of="count(*)").filter("low <> high")
    cut = cut.join(marks.select("node", "bits"), "node")
    mixed = swept(materialized(cut.selectExpr("gram", "node", "n", "pos", "root", "bits", f"cast((of - 1) / {crowd} AS int) AS last").withColumn("part", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int")), "copies-mixed"))
    x = mixed.selectExpr("*", "part AS low", "explode(sequence(part, last)) AS high").alias("x")
    y = mixed.selectExpr("*", "part AS high", "explode(sequence(0, part)) AS low").alias("y")
    pairs = (
        x.join(y, F.expr("x.gram = y.gram AND x.low = y.low AND x.high = y.high AND x.node < y.node AND x.root <> y.root"))
        .filter(_near("x", "y"))
        .filter(_even("x", "y"))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    others = swept(materialized(_alike(pairs, texts, shingle), "copies-pairs"))
    whole = components(tried.union(others).filter("alike").select("a", "b"))
    return joined(prints.select("doc_id", "text_hash", "node"), whole, "node").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, shingle: int = 5, crowd: int = CROWD) -> DataFrame:
    """(doc_id, group_id) for every row of docs(doc_id, text): group_id is the smallest doc_id of its near copies."""
    rows = materialized(copy_groups(docs, shingle, crowd), "copies-groups")
    named = rows.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return rows.join(named, "root").select("doc_id", "group_id")


def deduplicated(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """`docs`, with all columns, less all but one document of each group of near copies: see `_one_of_each`."""
    return _one_of_each(docs, copy_groups(docs.select("doc_id", "text"), shingle))

"""Exact duplicates by an extendible-hash index on shared files.

A text's key is a 64-bit hash. The directory cuts the range of keys into buckets: each holds the keys of one prefix, as
long as the bucket's depth. A bucket of more than `capacity` bytes of different texts is overfull and splits by its next
bits, which doubles the directory where they are longer than any before; a bucket of one key can't split and stays larger.
Owner tasks get runs of buckets, which are ranges of keys, and read them in the order of keys: texts of one key are compared
byte by byte, and different ones are chained. Each link is a row of the index, in files that all executors share; it
has the text, how many rows hold it and the largest id. Documents find their link by key and digest.

A hot text isn't sent around: tasks combine equal texts before they are shuffled, those of hot keys in two rounds, and
what the index says of hot links is broadcast to their documents (a thousand at most).

The directory is held by the driver and by tasks: 2^18 buckets at most, since the capacity grows with the input beyond.
`inserted` adds documents to an index: only buckets that get new keys are split and written anew.

Defined cases: a null text is an empty one, and empty texts are equal; a null id is smaller than any other, and keep_id is null
only if all ids of a text are; every row gives a row and counts, repeated ones too, and exactly one row of equal texts is
kept: of rows that repeat the largest id, any one, as they don't differ in id or text; rows of one id with different texts
are judged by their texts; texts of any length are compared whole; extra columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import materialized

#: Bytes of different texts in a bucket, and buckets at most.
CAPACITY, BUCKETS = 32 << 20, 1 << 18
#: Bits by which an overfull bucket is counted at once.
AHEAD = 4
#: A key of more rows than this share of all is hot.
HOT = 1 / 1000
#: Bytes of texts that a task combines before it sends them on; bytes of a batch that it sends.
_COMBINED, _SENT = 32 << 20, 4 << 20


@dataclass
class Directory:
    """Buckets in the order of keys: the first key of each, as an unsigned number, and the length of its prefix."""

    starts: np.ndarray
    depths: np.ndarray

    @staticmethod
    def of_depth(depth: int) -> Directory:
        """All prefixes of one length."""
        starts = np.arange(1 << depth, dtype=np.uint64) << np.uint64(64 - depth) if depth else np.zeros(1, np.uint64)
        return Directory(starts, np.full(1 << depth, depth, np.int64))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Where signed or unsigned 64-bit keys belong."""
        return np.searchsorted(self.starts, keys.view(np.uint64), side="right") - 1

    def cells(self, keys: np.ndarray) -> np.ndarray:
        """bucket * 2^AHEAD + the bits of the key that follow the bucket's prefix."""
        own = self.bucket(keys)
        depth = np.minimum(self.depths[own], 63).astype(np.uint64)
        return own << AHEAD | (keys.view(np.uint64) << depth >> np.uint64(64 - AHEAD)).astype(np.int64)

    def split(self, sizes: np.ndarray, keys: np.ndarray, capacity: int) -> tuple[Directory, np.ndarray]:
        """Overfull buckets in halves, again and again, as far as cells' bytes and numbers of keys tell: (directory, the
        new buckets' bytes)."""
        found = []

        def cut(start: int, depth: int, first: int, cells: int) -> None:
            size, n = int(sizes[first : first + cells].sum()), int(keys[first : first + cells].sum())
            if cells == 1 or depth >= 64 or size <= capacity or n < 2:
                found.append((start, depth, size))
                return
            cut(start, depth + 1, first, cells // 2)
            cut(start + (1 << 63 - depth), depth + 1, first + cells // 2, cells // 2)

        for i, (start, depth) in enumerate(zip(self.starts.tolist(), self.depths.tolist(), strict=True)):
            cut(start, depth, i << AHEAD, 1 << AHEAD)
        return Directory(np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int64)), np.array([f[2] for f in found], np.int64)


@dataclass
class Index:
    """The directory, the bytes from which its buckets split, and the links: (bucket, key, link, digest, text, keep_id,
    group_size).

    A link's bucket is named by the bucket's first key; links of one key are numbered from 0."""

    directory: Directory
    capacity: int
    links: DataFrame


def digests(docs: DataFrame, normalised: Callable[[Column], Column], key: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, row, key, digest, size) for every row of docs(doc_id, text); row is a number of its own."""
    text = normalised(F.coalesce("text", F.lit("")))
    told = docs.select("doc_id", text.alias("text"))
    return materialized(
        told.select("doc_id", F.monotonically_increasing_id().alias("row"), key(F.col("text")).alias("key"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("size")),
        "exact-digests",
    )


def _loads(keys: DataFrame, directory: Directory) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and numbers of keys(key, size) by cell."""
    held = keys.sparkSession.sparkContext.broadcast(directory)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, most = held.value, len(held.value.starts) << AHEAD
        sizes, n = np.zeros(most, np.int64), np.zeros(most, np.int64)
        for batch in batches:
            cells = own.cells(batch.column("key").to_numpy())
            sizes += np.bincount(cells, batch.column("size").to_numpy(), most).astype(np.int64)
            n += np.bincount(cells, minlength=most)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sizes[met]), pa.array(n[met])], ["cell", "size", "n"])

    found = keys.select("key", "size").mapInArrow(count, "cell long, size long, n long").groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, len(directory.starts) << AHEAD), np.int64)
    out[:, found["cell"].to_numpy()] = found["size"].to_numpy(), found["n"].to_numpy()
    held.destroy()
    return out[0], out[1]


def grown(directory: Directory, keys: DataFrame, capacity: int) -> tuple[Directory, np.ndarray]:
    """The directory with all overfull buckets split, and buckets' bytes, for keys(key, size)."""
    while True:
        before = len(directory.starts)
        directory, sizes = directory.split(*_loads(keys, directory), capacity)
        # Cells that are still overfull are counted again, further ahead; buckets that can't split don't come back.
        if len(directory.starts) == before or sizes.max(initial=0) <= capacity:
            return directory, sizes


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a few megabytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text])
        if size >= _SENT or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _later(a: object, b: object) -> object:
    """The larger id; null is the smallest."""
    return b if a is None else a if b is None else max(a, b)


def combined(rows: DataFrame, directory: Directory, owners: np.ndarray) -> DataFrame:
    """(owner, key, text, keep_id, group_size) of rows(key, text, keep_id, group_size): within a task, equal texts are one."""
    held = rows.sparkSession.sparkContext.broadcast((directory, owners))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, owner = held.value
        schema = None

        def entries(found: dict) -> Iterator[tuple]:
            keys = np.fromiter((k for k, _ in found), np.int64, len(found))
            for (o, ((key, text), (top, n))) in zip(owner[cut.bucket(keys)].tolist(), found.items(), strict=True):
                yield o, key, text, top, n

        found, size = {}, 0
        for batch in batches:
            schema = schema or pa.schema([("owner", pa.int32()), *((n, batch.schema.field(n).type) for n in ("key", "text", "keep_id", "group_size"))])
            for key, text, top, n in zip(*(batch.column(c) for c in ("key", "text", "keep_id", "group_size")), strict=True):
                own = key.as_py(), text.as_py()
                if own in found:
                    found[own] = _later(found[own][0], top.as_py()), found[own][1] + n.as_py()
                else:
                    found[own] = top.as_py(), n.as_py()
                    size += len(own[1])
                if size >= _COMBINED:
                    yield from _batches(entries(found), schema, 2)
                    found, size = {}, 0
        if found:
            yield from _batches(entries(found), schema, 2)

    kind = rows.schema["keep_id"].dataType.simpleString()
    return rows.select("key", "text", "keep_id", "group_size").mapInArrow(combine, f"owner int, key long, text binary, keep_id {kind}, group_size long")


def chained(entries: DataFrame, directory: Directory) -> DataFrame:
    """(bucket, key, link, digest, text, keep_id, group_size) of entries(key, text, keep_id, group_size), which must come
    in the order of keys, those of a key to one task: equal texts become one link, different texts of a key are chained."""
    held = entries.sparkSession.sparkContext.broadcast(directory)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, types = held.value, {}

        def ended(key: int | None, links: list[list]) -> Iterator[tuple]:
            if links:
                start = int(cut.starts[cut.bucket(np.array([key], np.int64))].view(np.int64)[0])
                marks = [hashlib.sha256(text).digest() for text, _, _ in links]
                if len(set(marks)) < len(marks):
                    raise ValueError(f"different texts of key {key} have one digest")
                for i, (mark, (text, top, n)) in enumerate(zip(marks, links, strict=True)):
                    yield start, key, i, mark, text, top, n

        def walked() -> Iterator[tuple]:
            now, links = None, []
            for batch in batches:
                types.update(keep_id=batch.schema.field("keep_id").type)
                for key, text, top, n in zip(*(batch.column(c) for c in ("key", "text", "keep_id", "group_size")), strict=True):
                    key, text = key.as_py(), text.as_py()
                    if key != now:
                        yield from ended(now, links)
                        now, links = key, []
                    for link in links:
                        if link[0] == text:  # byte by byte
                            link[1:] = _later(link[1], top.as_py()), link[2] + n.as_py()
                            break
                    else:
                        links.append([text, top.as_py(), n.as_py()])
            yield from ended(now, links)

        rows = walked()
        first = next(rows, None)
        if first is not None:
            schema = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("link", pa.int32()), ("digest", pa.binary()), ("text", pa.binary()), ("keep_id", types["keep_id"]), ("group_size", pa.int64())])
            yield from _batches((r for part in ((first,), rows) for r in part), schema, 4)

    kind = entries.schema["keep_id"].dataType.simpleString()
    return entries.select("key", "text", "keep_id", "group_size").mapInArrow(chain, f"bucket long, key long, link int, digest binary, text binary, keep_id {kind}, group_size long")


def _owners(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Buckets' owners: runs of buckets of about `capacity` bytes."""
    at = np.cumsum(sizes) - sizes
    return np.unique(at // max(1, capacity), return_inverse=True)[1].astype(np.int32)


def inserted(
    index: Index | None,
    docs: DataFrame,
    marked: DataFrame,
    normalised: Callable[[Column], Column],
    key: Callable[[Column], Column],
    capacity: int = CAPACITY,
) -> Index:
    """The index with docs(doc_id, text), whose digests are `marked`; without an index, a new one."""
    keys = marked.groupBy("key").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    old = None
    if index is not None:
        held = docs.sparkSession.sparkContext.broadcast(index.directory)

        def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts = held.value.starts[held.value.bucket(batch.column("key").to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(starts).view(np.int64))], ["bucket"])

        anew = F.broadcast(materialized(keys.select("key").mapInArrow(touched, "bucket long").distinct(), "exact-touched"))  # BUCKETS at most
        old, still = index.links.join(anew, "bucket", "left_semi"), index.links.join(anew, "bucket", "left_anti")
        keys = keys.unionByName(index.links.select("key", F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("n"))).groupBy("key").agg(F.max("size").alias("size"), F.sum("n").alias("n"))
    keys = materialized(keys, "exact-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = max(capacity if index is None else index.capacity, -(-4 * total // BUCKETS))
    # A new directory starts as large as it must be; what is overfull by chance splits.
    directory = index.directory if index is not None else Directory.of_depth((total // capacity).bit_length())
    directory, sizes = grown(directory, keys, capacity)
    owners = _owners(sizes, capacity)

    asked = docs.select("doc_id", normalised(F.coalesce("text", F.lit(""))).alias("text"))
    asked = asked.select(key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    hot = materialized(keys.filter(F.col("n") > rows * HOT).select("key"), "exact-hot")  # 1 / HOT rows at most
    entries = combined(asked.join(F.broadcast(hot), "key", "left_anti"), directory, owners)
    if not hot.isEmpty():
        # Thirty tasks' worth of a hot text becomes one before it goes to the owner.
        once = combined(asked.join(F.broadcast(hot), "key", "left_semi"), directory, owners).withColumn("part", F.floor(F.spark_partition_id() / 30))
        entries = entries.unionByName(combined(once.repartition("key", "part"), directory, owners))
    if old is not None:
        entries = entries.unionByName(combined(old, directory, owners))
    dealt = entries.repartitionById(int(owners.max(initial=0)) + 1, F.col("owner")).sortWithinPartitions("key")
    links = materialized(chained(dealt, directory), "exact-index")
    return Index(directory, capacity, links if old is None else links.unionByName(still))


def looked_up(marked: DataFrame, index: Index) -> DataFrame:
    """(doc_id, row, key, digest, keep_id, group_size) of documents' digests that the index has."""
    links = index.links.select("key", "digest", "keep_id", "group_size")
    rows = marked.count()
    # An index of more documents than are asked for can have large groups of which few rows are asked for: no matter.
    crowded = F.broadcast(marked.groupBy("key", "digest").agg(F.count("*").alias("n")).filter(F.col("n") > rows * HOT).select("key", "digest"))
    few = F.broadcast(links.join(crowded, ["key", "digest"], "left_semi"))
    most = marked.join(crowded, ["key", "digest"], "left_anti").join(links, ["key", "digest"])
    columns = ("doc_id", "row", "key", "digest", "keep_id", "group_size")
    return marked.join(few, ["key", "digest"]).select(*columns).union(most.select(*columns))


def _same(text: Column) -> Column:
    return text


def duplicates(docs: DataFrame, normalised: Callable[[Column], Column] = _same, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text); texts are equal if they are so
    once `normalised`."""
    marked = digests(docs, normalised, key)
    index = inserted(None, docs, marked, normalised, key, capacity)
    found = materialized(looked_up(marked, index), "exact-found")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Of rows that repeat the largest id, one is kept; these are few, also where a group is large.
    first = found.filter(same).groupBy("key", "digest").agg(F.min("row").alias("row"), F.count("*").alias("n")).filter("n > 1").select("key", "digest", F.col("row").alias("first"))
    twice = materialized(first, "exact-repeated")
    mine = found.filter(same).join(twice, ["key", "digest"], "left").withColumn("kept", F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    rest = found.filter(~same).withColumn("kept", F.lit(False))
    return mine.drop("first").unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

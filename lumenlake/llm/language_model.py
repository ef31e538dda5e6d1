"""Language-model scores from a log-frequency Bloom filter.

Counts of single tokens and of pairs are gathered over all training documents, and every n-gram is kept. Each, of count
c, is put into one filter once for every level up to its quantised logarithm; a count is read back by probing level after
level until one is missing. Levels overestimate where a bit pattern collides, and never underestimate.

The filter is cut into segments by key. A segment is sized by its own n-grams (`BITS_EACH` bits for each of their levels,
about 0.12 GB for a GB of compressed texts) and filled where the shuffle that adds up the counts has brought them. Up to `BROADCAST`
bytes all segments are broadcast together. A larger filter stays apart: the keys that documents ask for are sent to their
segments, probed there, and sent back; the keys that most documents ask for are broadcast with their counts, so that no
segment gets a third of all questions. Both ways give the same scores.

Probabilities of pairs are smoothed with those of single tokens by a Dirichlet prior. What is counted is taken at the
lower end of its level and what it is divided by at the upper end, so probabilities sum to one at most, but for collisions.

The base score needs exact counts. Tokens of high count (`COMMON` at most) are broadcast; all others of a document
leave its task as pairs of hash and count, which are joined to the table of counts.

Defined cases: null texts are empty and have one token, the end; a null id counts as the empty text in the split; rows
that repeat are all scored and, in training, all counted; without training documents nothing is known, and every token
has probability one in the base (log 0.1 / 0.1) and in the model; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import materialized, remainder

#: Bytes of a filter that is broadcast at most.
BROADCAST = 1 << 27
#: Documents for each segment, about.
SEGMENT = 256
#: Bits for each n-gram and level, and probes.
BITS_EACH, PROBES = 8, 5
#: Keys that are probed together: what this takes stays in a processor's cache.
TOGETHER = 1 << 15
#: Ratio of counts between levels.
RATIO = 1.5
LEVELS = 110
#: Exact counts that are broadcast at most, of single tokens and of pairs.
COMMON = 1 << 18
#: Pairs from this count on are written down: rarer ones are asked for by few documents.
OFTEN = 64
PRIOR = 200.0
ALPHA = 0.1

_hash = partial(xxhash.xxh64_intdigest, seed=7)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Keys are 63 bits of a hash; the last bit says whether it is a pair's.
PAIR = np.uint64(1)
END, START = np.uint64(_hash(b" ")) & ~PAIR, np.uint64(_hash(b"  ")) & ~PAIR  # no token holds a blank


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Quantised logarithms: 1 for a count of one."""
    return (1 + np.floor(np.log(counts) / np.log(RATIO) + 1e-9)).astype(np.int64)


def least_at(levels: np.ndarray) -> np.ndarray:
    """The least count that has a level; 0 at level 0."""
    return np.where(levels > 0, np.ceil(RATIO ** (levels - 1.0) - 1e-9), 0.0)


def most_at(levels: np.ndarray) -> np.ndarray:
    """The greatest count that has a level; 0 at level 0."""
    return np.where(levels > 0, np.maximum(np.ceil(RATIO ** (levels * 1.0) - 1e-9) - 1, least_at(levels)), 0.0)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before * GOLDEN + token) | PAIR


def _batch(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the different tokens of some texts, START last; which of them each token is, and the one before it; and
    the texts' lengths. Each different token is hashed once."""
    # ASCII white space and A-Z only, as bytes: nothing here looks at other characters, so they needn't be valid.
    whole = pc.fill_null(pa.array(texts, pa.binary()), b"").view(pa.string())
    each = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(each).to_numpy())
    told = each.flatten().dictionary_encode()
    names, kind = told.dictionary.view(pa.binary()), told.indices.to_numpy()
    real = pc.binary_length(names).to_numpy() > 0  # white space at an end of a text parts an empty token
    doc, kind = doc[real[kind]], (np.cumsum(real) - 1)[kind[real[kind]]]
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    # Each text's end, which is a token of its own, after its tokens.
    numbers = np.full(int(sizes.sum()), int(real.sum()))
    numbers[np.arange(len(kind)) + doc] = kind
    names = [*names.filter(pa.array(real)).to_numpy(zero_copy_only=False), b" "]
    hashes = np.fromiter(map(_hash, names), np.uint64, len(names)) & ~PAIR
    single, place = np.unique(hashes, return_inverse=True)
    token = place[numbers]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(sizes) - sizes] = len(single)
    return np.append(single, START), token, before, sizes


def _parts(batches: Iterator[pa.RecordBatch], most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with texts of about `most` bytes."""
    for batch in batches:
        lengths = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset :][: batch.num_rows + 1])
        step = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.nonzero(np.diff(step))[0] + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def counted(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, key, n): exact counts of all tokens and pairs of docs(text), whole segments in a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            single, token, before, _ = _batch(batch.column("text").to_pylist())
            pair, pair_n = np.unique(pair_keys(single[before], single[token]), return_counts=True)
            key, n = np.concatenate([single[:-1], pair]), np.concatenate([np.bincount(token, minlength=len(single) - 1), pair_n])
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(key, segments).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["segment", "key", "n"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "segment int, key long, n long")
    return parts.repartition("segment").groupBy("segment", "key").agg(F.sum("n").alias("n"))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of keys, their first bit aside, so ascending keys probe one after the other, twice through."""
    return (keys << np.uint64(1) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)


def positions(keys: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """PROBES bit positions for each key within its own number of bits, as rows."""
    h = mixed(keys + np.array([level], np.uint64) * GOLDEN)
    step = (h << np.uint64(32)) | (h >> np.uint64(32)) | np.uint64(1)
    draws = (h[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) >> np.uint64(32)
    return (draws * bits[None, :]) >> np.uint64(32)


def filled(keys: np.ndarray, counts: np.ndarray, each: int = BITS_EACH) -> np.ndarray:
    """A segment's bytes: the keys at all levels up to those of their counts."""
    level = levels_of(counts)
    bits = -(-int(level.sum()) * each // 64) * 64
    marks = np.zeros(bits, bool)
    for j in range(1, int(level.max()) + 1):
        own = keys[level >= j]
        marks[positions(own, j, np.full(len(own), bits, np.uint64)).ravel()] = True
    return np.packbits(marks, bitorder="little")


def packed(counts: DataFrame, segments: int, each: int = BITS_EACH) -> DataFrame:
    """(segment, data, key, n): a row with the bytes of each segment of counted(), and one for each token and often pair."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["segment", "data", "key", "n"]
        # A partition's n-grams: what one shuffle partition holds, 16 bytes each.
        held = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not held:
            return
        key = np.concatenate([k for k, _ in held]).view(np.uint64)
        n = np.concatenate([c for _, c in held])
        held.clear()
        segment = segment_of(key, segments)
        order = np.argsort(segment, kind="stable")
        key, n, segment = key[order], n[order], segment[order]
        found, first = np.unique(segment, return_index=True)
        for s, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([filled(key[a:b], n[a:b], each).tobytes()], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], names)
        shown = ((key & PAIR) == 0) | (n >= OFTEN)
        key, n = key[shown], n[shown]
        for a in range(0, len(key), 1 << 16):
            part = key[a : a + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[a : a + (1 << 16)])], names)

    return counts.mapInArrow(pack, "segment int, data binary, key long, n long")


class Filter:
    """Segments of bits, joined."""

    def __init__(self, segments: int, rows):
        """`rows` are (segment, data); a segment that is missing holds nothing."""
        found = sorted(((r[0], np.frombuffer(r[1], np.uint8)) for r in rows), key=lambda r: r[0])
        self.sizes = np.zeros(segments, np.uint64)
        for s, data in found:
            self.sizes[s] = len(data) * 8
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.concatenate([np.zeros(0, np.uint8), *(d for _, d in found)])

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self._levels(keys[a : a + TOGETHER]) for a in range(0, len(keys), TOGETHER))])

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        segment = segment_of(keys, len(self.sizes))
        alive = np.nonzero(self.sizes[segment])[0]
        keys, first, bits = keys[alive], self.starts[segment[alive]], self.sizes[segment[alive]]
        for level in range(1, LEVELS + 1):
            at = positions(keys, level, bits) + first
            there = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)
            alive, keys, first, bits = alive[there], keys[there], first[there], bits[there]
            if not len(alive):
                break
            out[alive] = level
        return out


@dataclass
class Model:
    """What scores need besides levels of keys."""

    tokens: int  # N
    types: int  # V
    starts: int  # training documents

    def single(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ALPHA) / (self.tokens + ALPHA * (self.types + 1))


def score_tokens(model: Model, singles: np.ndarray, token: np.ndarray, before: np.ndarray, levels: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """log10 probabilities of tokens after others, which are numbers of the different keys `singles`."""
    level = levels(singles)
    least, most = least_at(level), most_at(level)
    most[singles == START] = model.starts
    own, context = model.single(least)[token], most[before]
    pairs, where = np.unique(pair_keys(singles[before], singles[token]), return_inverse=True)
    both = np.minimum(least_at(levels(pairs))[where], context)
    return np.log10(np.minimum(1.0, (both + PRIOR * own) / (context + PRIOR)))


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether keys are among the ascending `known`, and their values, 0 where not."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), values.dtype)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    there = known[place] == keys
    return there, np.where(there, values[place], 0)


def _common(counts: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The count from which on COMMON rows of counts(key, n) at most are left, and those: keys, ascending, and counts."""
    # Counts by level, and below 64 each on its own: bounded by the number of levels.
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.pow(F.lit(RATIO), F.floor(F.log(RATIO, "n") + 1e-9)))).cast("long")
    least, so_far = 1, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("kinds")).collect(), reverse=True):
        so_far += r.kinds
        if so_far > COMMON:
            least = r.step + 1 if r.step < 64 else int(r.step * RATIO) + 2
            break
    top = counts.filter(F.col("n") >= least).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return least, (keys[order], top["n"].to_numpy(np.int64)[order])


def _sent_levels(first: DataFrame, segments: DataFrame, number: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, keys, levels) of the keys that first(row, tokens, befores) asks for, but for those that are common."""
    sc = first.sparkSession.sparkContext
    often = sc.broadcast(common[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                token, before = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in ("tokens", "befores"))
                keys = np.unique(np.concatenate([token, before, pair_keys(before, token)]))
                keys = keys[~looked_up(keys, often.value, often.value)[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment_of(keys, number).astype(np.int32)), pa.array(np.full(len(keys), batch.column("row")[i].as_py())), pa.array(keys.view(np.int64))], ["segment", "row", "key"]
                )

    def probe(asked: pa.Table, own: pa.Table) -> pa.Table:
        keys = asked.column("key").to_numpy().view(np.uint64)
        found = Filter(number, zip(own.column("segment").to_pylist(), own.column("data").to_pylist(), strict=True)).levels(keys)
        return pa.table({"row": asked.column("row"), "key": asked.column("key"), "level": pa.array(found)})

    asked = first.select("row", "tokens", "befores").mapInArrow(ask, "segment int, row long, key long")
    found = asked.groupBy("segment").cogroup(segments.groupBy("segment")).applyInArrow(probe, "row long, key long, level long")
    return found.filter("level > 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("key", "level"))).alias("found")).select("row", "found.key", "found.level")


def _scored_apart(first: DataFrame, model: Model, segments: DataFrame, number: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`first` with the score, where the filter isn't broadcast."""
    shared = first.sparkSession.sparkContext.broadcast((common[0], levels_of(common[1])))
    names = [c for c in first.columns if c not in ("tokens", "befores")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                token, before = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in ("tokens", "befores"))
                own = [np.zeros(0, np.int64) if batch.column(c)[i].values is None else batch.column(c)[i].values.to_numpy() for c in ("key", "level")]
                order = np.argsort(own[0].view(np.uint64))
                keys, values = own[0].view(np.uint64)[order], own[1][order]
                singles, at = np.unique(np.concatenate([token, before]), return_inverse=True)
                out[i] = score_tokens(model, singles, at[: len(token)], at[len(token) :], lambda k: np.maximum(looked_up(k, often, level)[1], looked_up(k, keys, values)[1])).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, "score"])

    both = first.join(_sent_levels(first, segments, number, common), "row", "left")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema if f.name in names)
    return both.mapInArrow(score, f"{kinds}, score double")


def scored(docs: DataFrame, most: int = BROADCAST, each: int = BITS_EACH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text).

    A filter of more than `most` bytes isn't broadcast; `each` is its bits for an n-gram and level."""
    spark = docs.sparkSession
    held = (remainder(F.col("doc_id"), 10) == 0).alias("held_out")
    train = docs.select("text", held).filter("NOT held_out")
    number = max(1, train.count() // SEGMENT)
    table = materialized(packed(counted(train, number), number, each), "ngrams")
    segments = table.filter("segment IS NOT NULL").select("segment", "data")
    shown = table.filter("segment IS NULL").select("key", "n")
    singles, pairs = (shown.filter(F.col("key").bitwiseAND(1) == k) for k in (0, 1))
    n, v = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    starts = singles.filter(F.col("key") == int(END.astype(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = Model(n, v, starts)
    least, exact = _common(singles)
    apart = (segments.agg(F.sum(F.octet_length("data"))).first()[0] or 0) > most
    bloom = None if apart else Filter(number, segments.toLocalIterator())
    shared = spark.sparkContext.broadcast((bloom, exact))
    # Taken off token by token: the difference of two large sums would lose digits.
    out_of = float(np.log10(n + ALPHA * (v + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, (known, known_n) = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in _parts(batches, 4_000_000):
            single, token, before, sizes = _batch(batch.column("text").to_pylist())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            common, number = looked_up(single, known, known_n)
            logs = np.where(common, np.log10(number + ALPHA) - out_of, 0.0)
            # Other tokens: once for each document, with their number there.
            rare = ~common[token]
            asked, numbers = np.unique(doc[rare] * len(single) + token[rare], return_counts=True)
            ends = np.searchsorted(asked, np.arange(len(sizes) + 1) * len(single)).astype(np.int32)
            whole = len(sizes)
            columns = {
                "row": pa.array(row + np.arange(whole)),
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": pa.array(sizes),
                "known": pa.array(np.bincount(doc, common[token], whole).astype(np.int64)),
                "logs": pa.array(np.bincount(doc, logs[token], whole)),
                "keys": pa.ListArray.from_arrays(ends, pa.array(single[asked % len(single)].view(np.int64))),
                "numbers": pa.ListArray.from_arrays(ends, pa.array(numbers)),
            }
            if bloom is None:
                ends = np.cumsum([0, *sizes]).astype(np.int32)
                columns |= {c: pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for c, x in (("tokens", single[token]), ("befores", single[before]))}
            else:
                columns["score"] = pa.array(np.bincount(doc, score_tokens(model, single, token, before, bloom.levels), whole))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            row += whole

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, keys array<long>, numbers array<long>"
    schema += ", tokens array<long>, befores array<long>" if apart else ", score double"
    asked = docs.select("doc_id", held, F.col("text").cast("binary").alias("text"))
    first = materialized(asked.mapInArrow(score, schema), "scores")
    others = first.select("row", F.explode(F.arrays_zip("keys", "numbers")).alias("t")).select("row", F.col("t.keys").alias("key"), F.col("t.numbers").alias("number"))
    looked = others.join(singles.filter(F.col("n") < least), "key", "left")
    more = looked.groupBy("row").agg(
        F.sum(F.col("number") * (F.log10(F.coalesce("n", F.lit(0)) + ALPHA) - out_of)).alias("more_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("number")).otherwise(0)).alias("more_known"),
    )
    rows = first.drop("keys", "numbers")
    if apart:
        frequent = _common(pairs)[1]
        both = np.concatenate([exact[0], frequent[0]])
        order = np.argsort(both)
        rows = _scored_apart(rows, model, segments, number, (both[order], np.concatenate([exact[1], frequent[1]])[order]))
    return rows.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("base_score"),
        "score",
    )

"""Resampling of documents towards a target by importance weights of hashed n-grams.

Features are runs of one to `most` consecutive words, joined by a blank; a feature's bucket is its bytes' CRC-32 modulo
`buckets`. A CRC is linear: that of two texts in a row is that of the first, multiplied by the matrix over GF(2) that
appends as many zero bytes as the second has, plus that of the second. So each word's CRC is computed once, and those of
n-grams are composed from words' CRCs and lengths, by matrices for powers of two of the length; no n-gram is ever a string.

Counts of buckets over all documents and over the target give each bucket's gain; a document's weight is the sum of its
features' gains. The highest scores are drawn, a score being the weight plus Gumbel noise that depends on the id only. Ranks
come from slices of the order, see `ordering.positions`.

Defined cases: a null text has no words; a text without words has weight 0 and isn't drawn; a null id counts as the empty
text for its noise and comes after all others of the same score; rows that repeat are all features, and all may be drawn:
they rank one after the other, different texts of one id by the hash of their text; texts of any length are counted
whole, within one task; extra columns are ignored, whatever their names. An empty target or an empty table of documents
is no error: counts are smoothed by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import WORD_BYTES, materialized
from lumenlake.operators.ordering import positions

BUCKETS = 10_000
MOST = 1
SEED = 2024
#: Per cent of the documents with so many words that are drawn.
SHARE, WORDS = 10, 20
#: Words whose CRCs a task remembers; then it starts anew. Words handled at once.
_REMEMBERED, _AT_ONCE = 300_000, 1 << 20
_POLYNOMIAL = 0xEDB88320


class _WordCrcs(dict):
    """word -> its CRC-32, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = zlib.crc32(word)
        if len(word) <= 64:
            self[word] = value
        return value


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), as a table for each of the four bytes, times vectors of 32 bits."""
    return matrix[0][vectors & 255] ^ matrix[1][vectors >> 8 & 255] ^ matrix[2][vectors >> 16 & 255] ^ matrix[3][vectors >> 24]


def _zero_byte() -> np.ndarray:
    """The matrix that appends a zero byte."""
    byte, place = np.meshgrid(np.arange(256, dtype=np.uint32), np.arange(4, dtype=np.uint32) * 8)
    vectors = byte << place
    for _ in range(8):
        vectors = vectors >> 1 ^ (vectors & 1) * np.uint32(_POLYNOMIAL)
    return vectors


#: Matrices that append 1, 2, 4, 8 ... zero bytes; as many as the lengths met so far need.
_SHIFTS = [_zero_byte()]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs, each multiplied by the matrix of its own number of zero bytes."""
    out, power = crcs.copy(), 0
    most = int(lengths.max(initial=0))
    while most >> power:
        if power == len(_SHIFTS):
            _SHIFTS.append(_times(_SHIFTS[-1], _SHIFTS[-1]))  # a matrix times itself, by columns
        own = np.flatnonzero(lengths >> power & 1)
        out[own] = _times(_SHIFTS[power], out[own])
        power += 1
    return out


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, doc: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. most: (CRCs, documents) of the runs of n words within one document; words of one document are
    consecutive and given by CRC, length and document."""
    yield crcs, doc
    if most > 1:
        blank = np.full(len(crcs), zlib.crc32(b" "), np.uint32)
        led, so_far = shifted(blank, lengths) ^ crcs, crcs  # led: with the blank before it
    for n in range(1, most):
        if len(crcs) <= n:
            return
        so_far = shifted(so_far[:-1], lengths[n:] + 1) ^ led[n:]
        whole = doc[:-n] == doc[n:]
        yield so_far[whole], doc[:-n][whole]


def _features(batch: pa.RecordBatch, buckets: int, most: int, known: _WordCrcs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents of the batch, n_words of each, buckets and documents of features), so many words at a time."""
    texts, at = batch.column("text"), 0
    while at < len(texts):
        first, parted, n = at, [], 0
        while at < len(texts) and n < _AT_ONCE:
            parted.append((texts[at].as_py() or b"").translate(WORD_BYTES).split())
            n += len(parted[-1])
            at += 1
        sizes = np.fromiter(map(len, parted), np.int64, len(parted))
        flat = [w for words in parted for w in words]
        crcs = np.fromiter(map(known.__getitem__, flat), np.uint32, n)
        lengths = np.fromiter(map(len, flat), np.int64, n) if most > 1 else np.zeros(n, np.int64)
        doc = np.repeat(np.arange(len(parted)), sizes)
        found = [(c % np.uint32(buckets), d) for c, d in ngram_crcs(crcs, lengths, doc, most)]
        yield np.arange(first, at), sizes, np.concatenate([b for b, _ in found]).astype(np.int64), np.concatenate([d for _, d in found])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST) -> np.ndarray:
    """How many features of texts(text) fall on each bucket: an array of `buckets` numbers, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), _WordCrcs()
        for batch in batches:
            for _, _, found, _ in _features(batch, buckets, most, known):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    summed = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) for each bucket, in doubles."""
    n = len(source)
    above = (target + 1.0) * (source.sum() + n)
    below = (source + 1.0) * (target.sum() + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, most: int = MOST) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) for every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = held.value, _WordCrcs()
        for batch in batches:
            words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, sizes, found, doc in _features(batch, len(own), most, known):
                words[rows] = sizes
                n[rows] = np.bincount(doc, minlength=len(rows))
                weight[rows] = np.bincount(doc, own[found], len(rows)).astype(np.int64)  # whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "text_hash", "n_words", "n_features", "weight"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return asked.mapInArrow(weigh, f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel variate) from the id: the first 32 bits of a digest are its place between 0 and 1."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST, share: int = SHARE, least: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs(doc_id, text): rank is null where not drawn.

    Of the documents with `least` words, `share` per cent are drawn, by score, then by doc_id."""
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    scored = materialized(weighted(docs, gain, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    may = scored.filter(F.col("n_words") >= least)
    drawn = may.count() * share // 100
    ranked = positions(may, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_hash")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")

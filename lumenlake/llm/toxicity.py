"""Toxicity by bags of subwords: embeddings of character n-grams, averaged, under a linear softmax.

A word's vector is the mean of the vectors of its n-grams (and of itself), a text's vector the mean over its distinct
words, so misspellings that were never seen share vectors with words that were. Embeddings and softmax are trained
jointly, in numpy on the driver, on a bounded sample: `SAMPLE` labelled ids of each class, those with the smallest
hashes, and of each id one text, that with the smallest hash. Vectors of n-grams that don't tell the classes apart there stay zero, else long texts would be learned by heart. As
everything up to the softmax is linear, a trained model is one number for each bucket of n-grams; that table of
`BUCKETS` numbers is broadcast, and whole texts are scored in Spark's tasks.

Defined cases: null texts are empty; a text without words has the score of the bias; null ids count as the empty text
in the split; without labelled rows of both classes every score is 0.5; rows that repeat are all kept; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import WORD_BYTES, materialized, remainder

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIMENSIONS = 8
#: Labelled rows of each class that are trained on at most.
SAMPLE = 4000
EPOCHS = 40
#: A bucket is trained on if label 1 has it more often by so many standard errors, in so many texts at least.
TELLING, LEAST = 3.5, 5
THRESHOLD = 0.7
#: Words whose scores a task remembers; then it starts anew.
REMEMBERED = 300_000


def buckets(word: bytes) -> list[int]:
    """The buckets of a word's n-grams and of the whole word, repeats included."""
    marked = "<" + word.decode("utf-8", "replace") + ">"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in (*grams, marked)]


def text_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def features(text: bytes, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their weights in its mean; of `kept` (by bucket) only, if given."""
    weights: dict[int, float] = {}
    found = set(text_words(text))
    for w in found:
        own = buckets(w)
        for b in own if kept is None else (b for b in own if kept[b]):
            weights[b] = weights.get(b, 0.0) + 1 / len(own) / len(found)
    return np.fromiter(weights.keys(), np.int32, len(weights)), np.fromiter(weights.values(), np.float32, len(weights))


def telling(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Which buckets are clearly more frequent in texts of label 1: counts by (bucket, label), and the labels' texts."""
    share = counts / np.maximum(totals, 1)
    both = counts.sum(axis=1) / max(1, totals.sum())
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / np.maximum(totals, 1)).sum())
    return ((share[:, 1] - share[:, 0]) / spread >= TELLING) & (counts[:, 1] >= LEAST)


@dataclass
class Model:
    """What the softmax adds for each bucket, and the bias: the score is their logistic sum."""

    table: np.ndarray
    bias: float


def trained(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax by Adagrad on rows (buckets, weights, label)."""
    labels = np.array([r[2] for r in rows])
    if len(set(labels)) < 2 or not any(len(r[0]) for r in rows):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    flat = np.concatenate([r[0] for r in rows])
    used = np.flatnonzero(np.bincount(flat, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    flat = place[flat]
    sizes = np.array([len(r[0]) for r in rows])
    ends = np.cumsum(sizes)
    weights = np.concatenate([r[1] for r in rows])
    del rows  # the driver needn't hold the sample twice
    vectors = rng.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    past = [np.full_like(x, 1e-6) for x in (vectors, softmax, bias)]
    rate, batch = 0.3, 32
    balance = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean()).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            where = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in own])
            doc = np.repeat(np.arange(len(own)), sizes[own])
            index, scale = flat[where], weights[where]
            means = np.zeros((len(own), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                means[:, d] = np.bincount(doc, vectors[index, d] * scale, len(own))
            z = means @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= balance[own, None] / len(own)
            back = p @ softmax.T
            touched, place = np.unique(index, return_inverse=True)
            grad = np.empty((len(touched), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                grad[:, d] = np.bincount(place, back[doc, d] * scale, len(touched))
            past[0][touched] += grad**2
            vectors[touched] -= step * grad / np.sqrt(past[0][touched])
            for x, g, s in ((softmax, means.T @ p, past[1]), (bias, p.sum(axis=0), past[2])):
                s += g**2
                x -= step * g / np.sqrt(s)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(table, float(bias[1] - bias[0]))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labels(doc_id, toxic) whose crc32(doc_id) mod 3 is not 1."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(remainder(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        own = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = own if chosen is None else chosen.union(own)
    chosen = F.broadcast(materialized(chosen, "toxicity-sample"))  # 2 * sample rows at most
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    one = held.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # ids may repeat
    texts = materialized(one.select("doc_id", "toxic", F.col("text").cast("binary").alias("text")), "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BUCKETS, 2), np.int64)
        for batch in batches:
            for t, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                counts[features(t.as_py() or b"")[0], label] += 1
        held = np.nonzero(counts.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held, 0]), pa.array(counts[held, 1])], ["bucket", "clean", "toxic"])

    summed = texts.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = summed.toArrow()  # BUCKETS rows at most; as columns, since as rows they take ten times the memory
    counts = np.zeros((BUCKETS, 2))
    counts[found["bucket"].to_numpy()] = np.stack([found["clean"].to_numpy(), found["toxic"].to_numpy()], axis=1)
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    kept = telling(counts, np.array([sizes.get(0, 0), sizes.get(1, 0)]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t.as_py() or b"", kept) for t in batch.column("text")]
            columns = [pa.array([x[i].tobytes() for x in own], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("toxic").cast(pa.int32())], ["doc_id", "buckets", "weights", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    extracted = texts.mapInArrow(extract, f"doc_id {kind}, buckets binary, weights binary, toxic int")

    def rows() -> list[tuple[np.ndarray, np.ndarray, int]]:
        sent = extracted.toArrow()  # 2 * sample rows at most
        order = sorted(range(sent.num_rows), key=list(map(str, sent["doc_id"].to_pylist())).__getitem__)
        own, weights = ([np.frombuffer(x.as_buffer(), t) for x in sent[c]] for c, t in (("buckets", np.int32), ("weights", np.float32)))
        labels = sent["toxic"].to_pylist()
        return [(own[i], weights[i], labels[i]) for i in order]

    return trained(rows())


class _WordScores(dict):
    """word -> what it adds; computed when first asked for."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = float(self.table[buckets(word)].mean())
        if len(word) <= 64:
            self[word] = value
        return value


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) for every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = held.value
        adds = _WordScores(table)
        for batch in batches:
            z = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column("text")):
                found = set(text_words(t.as_py() or b""))
                z[i] = bias + (sum(map(adds.__getitem__, found)) / len(found) if found else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "held_out", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return asked.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    return scored(docs, fitted(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that aren't predicted toxic."""
    model = fitted(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    names, schema = docs.columns, docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = held.value
        adds = _WordScores(table)
        low = np.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            stay = []
            for t in batch.column("text"):
                found = set(text_words((t.as_py() or "").encode()))
                stay.append(bias + (sum(map(adds.__getitem__, found)) / len(found) if found else 0.0) < low)
            yield batch.filter(pa.array(stay, pa.bool_())).select(names)

    return docs.mapInArrow(keep, schema)

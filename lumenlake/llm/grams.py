"""Places of word shingles in documents: what license scans and decontamination join.

Shingles meet by 64-bit hashes; whoever joins them verifies the words, which every place carries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import with_key, words

#: Words of a shingle at most.
LONGEST = 3
#: Known shingles that are broadcast at once; a longer list is joined in blocks of that size.
BLOCK = 200_000


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words, n_words) of docs(doc_id, text)."""
    parted = with_key(docs).select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    return parted.withColumn("n_words", F.size("words").cast("long"))


def neighbours(parted: DataFrame, *keep: str) -> DataFrame:
    """(*keep, pos, w0, w1, w2): every place of parted(words, *keep), its word and the two that follow, null past the end."""
    shifted = parted.select("*", F.col("words").alias("w0"), *(F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(1, LONGEST)))
    zipped = F.arrays_zip(*(f"w{i}" for i in range(LONGEST)))
    return shifted.select(*keep, F.posexplode(zipped).alias("pos", "w")).select(*keep, "pos", *(f"w.w{i}" for i in range(LONGEST)))


def hashed(k: int) -> Column:
    """The hash of a place's first k words; null where fewer follow."""
    return F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*(f"w{i}" for i in range(k))))


def shingles(places: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(*keep, pos, k, gram): the hashes of all shingles of the given sizes at neighbours' places."""
    if len(sizes) == 1:
        return places.select(*keep, "pos", F.lit(sizes[0]).alias("k"), hashed(sizes[0]).alias("gram")).filter("gram IS NOT NULL")
    each = F.array(*(F.struct(F.lit(k).alias("k"), hashed(k).alias("gram")) for k in sizes))
    return places.select(*keep, "pos", F.explode(each).alias("g")).select(*keep, "pos", "g.k", "g.gram").filter("gram IS NOT NULL")


def blocks(known: DataFrame, key: str, limit: int = BLOCK) -> Iterator[DataFrame]:
    """`known` in parts of about `limit` rows, each to be broadcast; rows of one key stay together."""
    n = max(1, -(-known.count() // limit))
    for i in range(n):
        yield F.broadcast(known.filter(F.pmod(F.xxhash64(F.col(key), F.lit(n)), F.lit(n)) == i) if n > 1 else known)

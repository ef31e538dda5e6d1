"""What the operators of this subpackage share: reading tables, naming documents, and splitting texts into words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.lineage import materialized

__all__ = ["WORD_BYTES", "ascii_lower", "materialized", "remainder", "table", "tokens", "with_key", "words"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that no word holds: all but digits and letters.
SIGNS = "".join(chr(b) for b in range(128) if not chr(b).isalnum())
#: White space that parts tokens, besides the blank.
SPACES = "\t\n\x0b\x0c\r"

#: For bytes of UTF-8: lower-cases A-Z and turns every ASCII character that no word holds into a blank.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def _parted(text: Column, by: str) -> Column:
    # Several times as fast as a regular expression: one walk over the text, then a split at blanks.
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + by, UPPER.lower() + " " * len(by))
    return F.array_remove(F.split(plain, " "), "")


def words(text: Column) -> Column:
    """Runs of characters other than ASCII signs, blanks and control characters, A-Z lower-cased; a null text has none."""
    return _parted(text, SIGNS)


def tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space, A-Z lower-cased; a null text has none."""
    return _parted(text, SPACES)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def with_key(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns `keep` and `text_hash`: (doc_id, text_hash) names a document where ids repeat."""
    return docs.select(*keep, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

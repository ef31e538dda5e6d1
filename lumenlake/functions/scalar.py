"""Scalar expressions: clamps, the two roundings, hashes, times of day, names and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null; greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def unit(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def ramp(x: Column, low: float, high: float) -> Column:
    return unit((x - low) / (high - low)) if high > low else F.when(x >= high, 1.0).otherwise(0.0)


def round_even(x: Column, digits: int) -> Column:
    """Ties to even on the scaled double, unlike bround, which looks at decimals."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def round_away(x: Column, digits: int) -> Column:
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def hash64(digits: Column) -> Column:
    """16 hexadecimal digits as a long, by two's complement."""
    return F.conv(digits, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def epoch_seconds(ts: Column) -> Column:
    """Seconds with fractions, of a timestamp or a timestamp without zone taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.between(5, 7), "dawn")
        .when(hour.between(8, 11), "morning")
        .when(hour.between(12, 16), "afternoon")
        .when(hour.between(17, 19), "evening")
        .when(hour.isNotNull(), "night")
        .otherwise("unknown")
    )


# The order of times of day.
TIMES = ("dawn", "morning", "afternoon", "evening", "night")


def time_proximity(a: Column, b: Column) -> Column:
    """1 for the same time, 0.35 less for each step around the day; 0.5 if either is unknown."""
    i, j = (F.array_position(F.lit(list(TIMES)), x) for x in (a, b))
    apart = F.abs(i - j)
    return F.when((i == 0) | (j == 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.35 * F.least(apart, 5 - apart)))


def focal_bucket(mm: Column) -> Column:
    return (
        F.when(mm.isNull() | (mm <= 0), "unknown")
        .when(mm < 20, "ultra_wide")
        .when(mm < 35, "wide")
        .when(mm < 70, "normal")
        .when(mm < 135, "short_tele")
        .when(mm < 300, "tele")
        .otherwise("super_tele")
    )


def exposure_proximity(pairs: list[tuple[Column, Column]]) -> Column:
    """1 less the mean difference over 0.3 of those features that both have; 0.5 if there are none."""
    apart = F.filter(F.array(*(F.abs(a - b) for a, b in pairs)), lambda x: x.isNotNull())
    mean = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(apart), F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - mean / 0.3), F.lit(0.5))


def jaccard_tags(a: Column, b: Column) -> Column:
    """Two empty sets 0.5, one empty 0.3, else the share of common tags."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.3)
        .otherwise(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)))
    )


def stable_id(*fields: Column) -> Column:
    """meta1: and the md5 of all fields joined by a pipe, missing ones as empty strings; null if all are empty."""
    filled = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    joined = F.concat_ws("|", *filled)
    return F.when(F.concat(*filled) != "", F.concat(F.lit("meta1:"), F.md5(joined)))


def photo_id(own: Column, legacy: Column) -> Column:
    """The first of both that is set, trimmed; a blank one is none and doesn't fall through."""
    return F.nullif(F.trim(F.coalesce(own, legacy)), F.lit(""))


def string_set(json: Column) -> Column:
    """Sorted distinct non-empty strings of a JSON list in a string; empty if it is none."""
    listed = F.from_json(json, "array<string>")
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != "")))), F.array().cast("array<string>"))


def is_set(value: Column) -> Column:
    """Whether a string flag counts as set: neither missing nor empty nor false."""
    return F.coalesce((value != "") & (F.lower(value) != "false"), F.lit(False))


# Endings of raw files.
RAW = ("3fr", "arw", "cr2", "cr3", "crw", "dng", "erf", "fff", "iiq", "kdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "rwl", "sr2", "srf", "srw", "x3f")


def is_raw_name(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*RAW)


def eszett(text: Column) -> Column:
    return F.replace(text, F.lit("ß"), F.lit("ss"))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Decimal degrees, negative to the south and west, to six digits."""
    return F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1) * round_away(d + m / 60 + s / 3600, 6)


def wrapped(x: Column, low: float, high: float) -> Column:
    """Values that go round, such as hues."""
    return F.lit(low) + F.pmod(x - low, F.lit(high - low))


def search_url(base: str, *terms: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.concat_ws(" ", *terms)))

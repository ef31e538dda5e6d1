"""Tolerant parsing: what a language model answered, names of taxa, and lists of tasks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of open nomenclature, after which no name follows.
OPEN_NOMENCLATURE = ("sp", "spp", "cf", "aff", "indet", "nr", "var", "subsp")
GENUS, EPITHET = r"^[A-Z][a-z-]+$", r"^[a-z][a-z-]*$"
#: The task of a request that names none. Fixed value.
TASK = "embeddings"
_FENCE = "```"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unfenced(reply: Column) -> Column:
    """A reply without the fence that it begins with, that fence's line, and whatever follows the last fence."""
    opened = F.regexp_replace(stripped(reply), rf"^{_FENCE}(?:[^\n]*\n)?", "")
    ahead = F.length(opened) - F.locate(_FENCE, F.reverse(opened)) - 2
    return F.when(F.contains(opened, F.lit(_FENCE)), stripped(F.substring(opened, F.lit(1), ahead))).otherwise(opened)


def first_list(text: Column) -> Column:
    """The first list of JSON in a text, as JSON: from the first `[` to the bracket that closes it, null where none does.

    One fold over the characters; brackets in strings don't count. Whether it is sound JSON is left to the parser."""
    state = lambda depth, quoted, escaped, at, end: F.struct(depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), at.alias("at"), end.alias("end"))
    no, zero = F.lit(False), F.lit(0)

    def step(s: Column, c: Column) -> Column:
        at, outside = s["at"] + 1, ~s["quoted"]
        opens, closes = outside & c.isin("[", "{"), outside & c.isin("]", "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        quoted = F.when((c == '"') & ~s["escaped"], outside).otherwise(s["quoted"])
        moved = state(depth, quoted, s["quoted"] & (c == "\\") & ~s["escaped"], at, F.when(closes & (depth == 0), at).otherwise(zero))
        return F.when(s["end"] > 0, s).otherwise(moved)

    rest = F.substring(text, F.locate("[", text), F.length(text))
    end = F.aggregate(F.split(rest, ""), state(zero, no, no, zero, zero), step, lambda s: s["end"])
    return F.when(F.contains(text, F.lit("[")), F.when(end > 0, F.substring(rest, F.lit(1), end)))


def reply_groups(reply: Column, expected: Column) -> Column:
    """The groups that a reply confirms, an array of arrays of words; null if it holds no list, or a broken one.

    Items after the `expected` first are left out, missing ones are empty. What isn't a list of two words or more, blank
    ones and other values not counted, confirms nothing."""
    items = F.slice(F.try_variant_get(F.try_parse_json(first_list(unfenced(reply))), "$", "array<variant>"), F.lit(1), F.greatest(expected, F.lit(0)))

    def words(item: Column) -> Column:
        members = F.coalesce(F.try_variant_get(item, "$", "array<variant>"), F.array().cast("array<variant>"))
        texts = F.filter(members, lambda m: F.schema_of_variant(m) == "STRING")
        return F.filter(F.transform(texts, lambda m: stripped(F.try_variant_get(m, "$", "string"))), lambda w: w != "")

    return F.filter(F.transform(F.filter(items, lambda i: i.isNotNull()), words), lambda g: F.size(g) >= 2)


def usable_genus(genus: Column) -> Column:
    """Whether a genus is one capitalised word."""
    return F.coalesce(genus.rlike(GENUS), F.lit(False))


def epithet(species: Column) -> Column:
    """The first word that looks like an epithet: no authority, and no genus of an earlier name. Null if there is none, or
    if a mark of open nomenclature comes before it, as nothing behind that is a name."""
    marks = lambda w: F.lower(F.rtrim(w, F.lit("."))).isin(*OPEN_NOMENCLATURE)
    telling = F.filter(F.split(stripped(species), r"(?U)\s+"), lambda w: marks(w) | w.rlike(EPITHET))
    first = F.get(telling, F.lit(0))
    return F.when(~marks(first), first)


def tasks(text: Column) -> Column:
    """The tasks that a request's text names: a list of JSON, or words between commas, which broken JSON counts as too.
    No text, or an empty one, names `embeddings`."""
    split = F.transform(F.split(text, ","), stripped)
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    whole = F.when(F.forall(parsed, lambda v: v.isNotNull() & (F.schema_of_variant(v) == "STRING")), F.transform(parsed, lambda v: F.try_variant_get(v, "$", "string")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(TASK))).when(text.startswith("["), F.coalesce(whole, split)).otherwise(split)

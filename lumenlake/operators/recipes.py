"""Edit recipes as a model wrote them, JSON of any shape, brought to typed columns with what was left out and why.

All of it is expressions on variants: nothing leaves the JVM, and a recipe that isn't one costs a warning, not the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.scalar import clamp, round_away
from lumenlake.operators.style import RANGES, cropped, in_range
from lumenlake.plans.lineage import materialized

#: Different recipes, and characters of them, that are read once and broadcast.
FEW, FEW_CHARS = 5000, 8_000_000

# Names and ranges of the parts of a recipe.
TONES = {"highlights": (-100.0, 100.0), "lights": (-100.0, 100.0), "darks": (-100.0, 100.0), "shadows": (-100.0, 100.0), "shadow_split": (0.0, 100.0), "midtone_split": (0.0, 100.0), "highlight_split": (0.0, 100.0)}
CURVES, CURVE_TOP, EXTENDED_TOP = ("master", "red", "green", "blue"), 255.0, 4096.0
HSL_CHANNELS = ("red", "orange", "yellow", "green", "aqua", "blue", "purple", "magenta")
HSL = {"hue": (-100.0, 100.0), "saturation": (-100.0, 100.0), "luminance": (-100.0, 100.0)}
GRADED = ("shadows", "midtones", "highlights")
GRADING = {"hue": (0.0, 360.0), "saturation": (0.0, 100.0), "luminance": (-100.0, 100.0)}
GRADING_GLOBAL = {"hue": (0.0, 360.0), "saturation": (0.0, 100.0)}
GRADING_LEVELS = {"blending": (0.0, 100.0), "balance": (-100.0, 100.0)}
MASK_KINDS = ("subject", "sky", "background")
MASK_RANGES = {
    "exposure": (-5.0, 5.0), "contrast": (-100.0, 100.0), "highlights": (-100.0, 100.0), "shadows": (-100.0, 100.0), "whites": (-100.0, 100.0),
    "blacks": (-100.0, 100.0), "temperature": (-100.0, 100.0), "tint": (-100.0, 100.0), "texture": (-100.0, 100.0), "clarity": (-100.0, 100.0),
    "dehaze": (-100.0, 100.0), "saturation": (-100.0, 100.0), "sharpness": (-100.0, 100.0), "noise": (-100.0, 100.0), "moire": (-100.0, 100.0),
}
# Texts that users see.
UNNAMED = "AI-generated Lightroom edit recipe"
INVALID = "LLM returned an invalid edit recipe payload."
IN_KELVIN = "Ignored temperature: the model answered in Kelvin for a non-raw photo, where Lightroom expects a relative -100..100 value."
CROP_ORDER = {
    "left_not_before_right": "Ignored crop: left edge was not smaller than right edge after normalization.",
    "top_not_before_bottom": "Ignored crop: top edge was not smaller than bottom edge after normalization.",
}
NO_CROP = "Ignored crop: no supported crop fields were returned by the model."
NO_OBJECT = "Ignored mask #%d: expected an object."
NO_KIND = "Ignored mask #%d: unsupported kind '%s'."
NO_ADJUSTMENTS = "Ignored mask '%s': adjustments were missing."
NONE_SUPPORTED = "Ignored mask '%s': no supported adjustments were returned."

_NUMBER = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|true|false)\s*$"


def once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is named: within lambdas nothing is shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(v: Column) -> Column:
    """A variant's text without blanks around it; empty if it is no text."""
    text = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", text), F.lit(""))


def number(v: Column) -> Column:
    """A variant's number: also of a text in digits, and one or zero of a boolean (its text is no number); else null."""
    return F.when(F.try_variant_get(v, "$", "string").rlike(_NUMBER), F.try_variant_get(v, "$", "double"))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def fields(v: Column) -> Column:
    """A variant's fields; none if it is no object."""
    return F.coalesce(_object(v), F.create_map().cast("map<string,variant>"))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _at(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def numbers(m: Column, names) -> Column:
    """The numbers of the named fields."""
    return F.transform_values(F.map_filter(m, lambda k, v: k.isin(*names)), lambda k, v: number(v))


def held(m: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    """The named fields that are numbers, held to their ranges, to four digits."""
    low, high = (F.create_map(*(F.lit(x) for k, r in ranges.items() for x in (k, r[i]))) for i in (0, 1))
    found = F.map_filter(numbers(m, ranges), lambda k, v: v.isNotNull())
    return F.transform_values(found, lambda k, v: round_away(clamp(v, F.element_at(low, k), F.element_at(high, k)), 4))


def _sections(m: Column, names: tuple[str, ...], ranges: dict[str, tuple[float, float]]) -> Column:
    """Of the named fields, those that hold something."""
    each = F.transform_values(F.map_filter(m, lambda k, v: k.isin(*names)), lambda k, v: held(fields(v), ranges))
    return F.map_filter(each, lambda k, v: F.size(v) > 0)


def points(v: Column, top: float) -> Column:
    """x1, y1, x2, y2 ... of a curve, whole numbers from 0 to `top`: given flat, as pairs or as objects with x and y. A last
    x without a y is left out; null for fewer than two points."""
    part = lambda p, path: number(F.try_variant_get(p, path, "variant"))

    def pair(p: Column) -> Column:
        both = F.array(F.coalesce(part(p, "$.x"), part(p, "$[0]")), F.coalesce(part(p, "$.y"), part(p, "$[1]")))
        return once(both, lambda xy: F.when(F.exists(xy, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(xy))

    def found(items: Column) -> Column:
        paired = F.schema_of_variant(F.get(items, F.lit(0))).rlike("^(OBJECT|ARRAY)")
        return F.when(F.size(items) >= 2, F.when(paired, F.flatten(F.transform(items, pair))).otherwise(F.array_compact(F.transform(items, number))))

    whole = lambda x: F.floor(F.floor(clamp(x, 0.0, top) * 10000 + 0.5) / 10000 + 0.5).cast("long")
    even = lambda f: F.when(F.size(f) >= 4, F.transform(F.slice(f, 1, F.size(f) - F.size(f) % 2), whole))
    return once(once(_items(v), found), even)


def _curves(v: Column, top: float) -> Column:
    each = F.transform_values(F.map_filter(fields(v), lambda k, x: k.isin(*CURVES)), lambda k, x: points(x, top))
    return F.map_filter(each, lambda k, x: x.isNotNull())


def _mask(v: Column, at: Column) -> Column:
    def read(m: Column) -> Column:
        name, moves = trimmed(_at(m, "name")), _object(_at(m, "adjustments"))
        invert = F.when(F.schema_of_variant(_at(m, "invert")) == "BOOLEAN", F.try_variant_get(_at(m, "invert"), "$", "boolean"))
        return F.struct(
            m.isNotNull().alias("given"), F.lower(trimmed(_at(m, "kind"))).alias("kind"), once(moves, lambda x: held(x, MASK_RANGES)).alias("adjustments"), F.nullif(name, F.lit("")).alias("name"), invert.alias("invert")
        )

    def judge(m: Column) -> Column:
        why = (
            F.when(~m["given"], F.format_string(NO_OBJECT, at + 1))
            .when(~m["kind"].isin(*MASK_KINDS), F.format_string(NO_KIND, at + 1, F.coalesce(F.nullif(m["kind"], F.lit("")), F.lit("unknown"))))
            .when(m["adjustments"].isNull(), F.format_string(NO_ADJUSTMENTS, m["kind"]))
            .when(F.size(m["adjustments"]) == 0, F.format_string(NONE_SUPPORTED, m["kind"]))
        )
        return F.struct(m["kind"].alias("kind"), m["adjustments"].alias("adjustments"), m["name"].alias("name"), m["invert"].alias("invert"), why.alias("why"))

    return once(once(_object(v), read), judge)


def normalized(rows: DataFrame, recipe: str = "recipe", raw: str | None = None) -> DataFrame:
    """`rows` with a column `normalized` in place of `recipe`, JSON text:

    struct<summary, settings, crop, tones, curves, extended_curves, hsl, grading, grading_levels, masks, warnings>, all maps
    of numbers by name (curves: lists of numbers), empty where nothing fits. Settings are those of `style.RANGES`;
    temperature and tint may stand under `white_balance` too. `raw`: a boolean column; null or missing is raw.
    What is no JSON object, null and empty texts gives empty parts and a warning."""
    is_raw = F.lit(True) if raw is None else F.coalesce(F.col(raw), F.lit(True))
    keep = [F.col(f"`{c}`") for c in rows.columns if c != recipe]
    kept = F.struct(*keep) if keep else F.struct(F.lit(0).alias("_"))
    data = F.try_variant_get(F.try_parse_json(F.col(recipe)), "$", "map<string,variant>")
    base = rows.select(kept.alias("kept"), is_raw.alias("raw"), data.alias("data"))
    base = base.select("kept", "raw", F.col("data").isNotNull().alias("valid"), F.coalesce("data", F.create_map().cast("map<string,variant>")).alias("d"))
    g = base.withColumns({"g": fields(_at(F.col("d"), "global")), "masks": F.transform(_items(_at(F.col("d"), "masks")), _mask)})
    g = g.withColumn("crop", _object(_at(F.col("g"), "crop"))).withColumns({
        "held": in_range(numbers(F.col("g"), RANGES), F.col("raw")),
        "balance": in_range(numbers(fields(_at(F.col("g"), "white_balance")), ("temperature", "tint")), F.col("raw")),
        "tone": fields(_at(F.col("g"), "tone_curve")),
        "colour": fields(_at(F.col("g"), "color_grading")),
        "cut": F.struct(*(x.alias(n) for x, n in zip(cropped(numbers(F.coalesce("crop", F.create_map().cast("map<string,variant>")), ("left", "right", "top", "bottom", "x", "y", "width", "height", "angle", "rotation"))), ("edges", "reasons"), strict=True))),
    })
    has_crop = F.col("crop").isNotNull()
    own = F.filter(F.transform(_items(_at(F.col("d"), "warnings")), trimmed), lambda t: t != "")
    texts = F.create_map(*(F.lit(x) for pair in CROP_ORDER.items() for x in pair))
    warnings = F.when(~F.col("valid"), F.array(F.lit(INVALID))).otherwise(F.concat(
        own,
        F.array_compact(F.array(F.when(F.map_contains_key("g", "temperature") & ~F.map_contains_key("held", "temperature"), IN_KELVIN))),
        F.transform("cut.reasons", lambda r: F.element_at(texts, r)),
        F.array_compact(F.array(F.when(has_crop & (F.size("cut.edges") == 0), NO_CROP))),
        F.array_compact(F.transform("masks", lambda m: m["why"])),
    ))
    summary = trimmed(_at(F.col("d"), "summary"))
    whole = F.struct(
        F.when(~F.col("valid"), "").when(summary == "", UNNAMED).otherwise(summary).alias("summary"),
        F.map_concat("held", F.map_filter("balance", lambda k, v: ~F.map_contains_key(F.col("held"), k))).alias("settings"),
        F.col("cut.edges").alias("crop"),
        held(F.col("tone"), TONES).alias("tones"),
        _curves(_at(F.col("tone"), "point_curve"), CURVE_TOP).alias("curves"),
        _curves(_at(F.col("tone"), "extended_point_curve"), EXTENDED_TOP).alias("extended_curves"),
        _sections(fields(_at(F.col("g"), "hsl")), HSL_CHANNELS, HSL).alias("hsl"),
        F.map_concat(_sections(F.col("colour"), GRADED, GRADING), _sections(F.col("colour"), ("global",), GRADING_GLOBAL)).alias("grading"),
        held(F.col("colour"), GRADING_LEVELS).alias("grading_levels"),
        F.transform(F.filter("masks", lambda m: m["why"].isNull()), lambda m: m.dropFields("why")).alias("masks"),
        warnings.alias("warnings"),
    )
    return g.select("kept", whole.alias("normalized")).select(*([F.col("kept.*")] if keep else []), "normalized")


def normalized_once(rows: DataFrame, recipe: str = "recipe", raw: str | None = None) -> DataFrame:
    """The same as `normalized`. Where a table has few different recipes, each is read once, and all rows get what it came to
    by broadcast; otherwise rows are read one by one, and none is shuffled."""
    key = [recipe, *([raw] if raw else [])]
    told = rows.agg(F.approx_count_distinct(F.struct(*key), 0.02).alias("n"), F.coalesce(F.max(F.length(recipe)), F.lit(0)).alias("longest")).first()
    if told.n > FEW or told.n * told.longest > FEW_CHARS:
        return normalized(rows, recipe, raw)
    different = rows.select(*key).distinct().withColumn("__text", F.col(recipe))
    read = materialized(normalized(different, "__text", raw), "recipes")
    found = read.select("normalized", *(F.col(c).alias(f"__{c}") for c in key))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key))
    return rows.join(F.broadcast(found), same).select(*(c for c in rows.columns if c != recipe), "normalized")

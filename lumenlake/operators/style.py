"""Style recommendation: composite scores, weighted blends of sparse settings, edit budgets and value ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.scalar import clamp, ramp, round_away, unit
from lumenlake.functions.vector import dot

# Weights of the composite score, and the size of the pool and of the choice.
CLIP, EXPOSURE, SCENE, TIME = 0.50, 0.25, 0.15, 0.10
POOL, WINNERS, ENOUGH = 20, 3, 5
# Scenes in the order of their tags, and the least product with a probe.
SCENES = (
    "scene_portrait", "scene_landscape", "scene_architecture", "scene_wildlife", "scene_event", "scene_street", "scene_macro", "scene_interior", "scene_exterior",
    "scene_golden_hour", "scene_studio", "scene_action",
)
SCENE_FLOOR = 0.22


def clip_similarity(cosine_distance: Column) -> Column:
    return unit(1 - 2 * cosine_distance / 2)


def scene_tags(image: Column, probes: list[list[float]], floor: float = SCENE_FLOOR) -> Column:
    """The scenes whose probe, a vector of any length, an image comes near, in the order of SCENES. Images are taken as they
    are, not scaled to unit length. No vector has no tags."""
    units = [[x / math.hypot(*p) for x in p] for p in probes]
    found = F.array(*(F.when(dot(image, F.lit(u)) >= floor, F.lit(s)) for s, u in zip(SCENES, units)))
    return F.array_compact(found)


def composite(clip: Column, exposure: Column, scene: Column, time: Column) -> Column:
    return CLIP * clip + EXPOSURE * exposure + SCENE * scene + TIME * time


def blended(winners: DataFrame, score: str, settings: str, by: list[str]) -> DataFrame:
    """(by, key, value): settings of the winners weighted by score, to one digit. A missing key counts as zero."""
    total = winners.groupBy(*by).agg(F.sum(score).alias("total"))
    each = winners.select(*by, score, F.explode(settings).alias("key", "value")).join(total, by)
    return each.filter("total > 0").groupBy(*by, "key").agg(round_away(F.sum(F.col(score) / F.col("total") * F.col("value")), 1).alias("value"))


def compensation(query: Column, mean: Column, factor: float, most: float, dead: float, digits: int) -> Column:
    """What brightness or contrast should be changed by; nothing within the dead band. Missing values are 0.5."""
    move = clamp(-factor * (F.coalesce(query, F.lit(0.5)) - F.coalesce(mean, F.lit(0.5))), -most, most)
    return F.when(F.abs(move) > dead, round_away(move, digits)).otherwise(0.0)


# Budgets of edits and where they change.
CONTRAST, CLARITY, SHADOW, FLAT = 25.0, 20.0, 60.0, 40.0
HARD, HIGH_RANGE, LOW_RANGE, BRIGHT, ISO_FREE, ISO_SPENT, BLOCKED = 0.55, 6.5, 3.5, 0.02, 400.0, 6400.0, 0.25


def budget(hardness: Column, stops: Column, specular: Column, highlight: Column, shadow: Column, raw: Column, iso: Column) -> list[Column]:
    """What a frame can take: contrast, clarity, shadows, whites, reasons."""
    hard = hardness >= HARD
    flat = (stops <= LOW_RANGE) & ~hard
    bright = (specular >= BRIGHT) | (highlight >= BRIGHT)
    spent = F.coalesce(ramp(iso, ISO_FREE, ISO_SPENT), F.lit(0.0))
    zero = F.lit(0.0)
    contrast = F.when(hard | (stops >= HIGH_RANGE), zero).when(flat, F.lit(FLAT)).otherwise(F.lit(CONTRAST))
    clarity = F.least(F.when(hard, zero).otherwise(F.lit(CLARITY)), F.when(spent > 0, CLARITY * (1 - 0.5 * spent)).otherwise(F.lit(CLARITY)))
    lifted = SHADOW * (1 - 0.75 * spent)
    shadows = F.when(shadow >= BLOCKED, F.least(lifted, F.lit(SHADOW * 0.25))).otherwise(lifted)
    whites = F.when(bright & raw, F.lit(CONTRAST * 0.5)).when(bright, zero).otherwise(F.lit(CONTRAST))
    reasons = F.array_compact(
        F.array(
            F.when(hard, "hard_light_no_added_contrast"),
            F.when(~hard & (stops >= HIGH_RANGE), "no_tonal_headroom"),
            F.when((stops < HIGH_RANGE) & flat, "flat_light_contrast_allowed"),
            F.when(bright & ~raw, "highlights_unrecoverable"),
            F.when(spent > 0.5, "high_iso_shadows_limited"),
            F.when(shadow >= BLOCKED, "shadows_already_clipped"),
        )
    )
    return [contrast.alias("contrast"), clarity.alias("clarity"), shadows.alias("shadows"), whites.alias("whites"), reasons.alias("reasons")]


def fitted(moves: Column, most: Column) -> Column:
    """Positive moves scaled so that their sum fits the budget; negative ones spend nothing."""
    spend = F.aggregate(moves, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))
    scale = F.when((spend <= most) | (spend <= 0), F.lit(1.0)).otherwise(unit(most / F.nullif(spend, F.lit(0.0))))
    return F.transform(moves, lambda x: F.when(x > 0, x * scale).otherwise(x))


# Ranges of settings. Temperatures are Kelvin for raw files, and relative for others, where a value beyond
# KELVIN can only be meant as Kelvin.
RANGES = {
    "exposure": (-5.0, 5.0),
    "contrast": (-100.0, 100.0),
    "highlights": (-100.0, 100.0),
    "shadows": (-100.0, 100.0),
    "whites": (-100.0, 100.0),
    "blacks": (-100.0, 100.0),
    "temperature": (2000.0, 50000.0),
    "tint": (-150.0, 150.0),
    "texture": (-100.0, 100.0),
    "clarity": (-100.0, 100.0),
    "dehaze": (-100.0, 100.0),
    "vibrance": (-100.0, 100.0),
    "saturation": (-100.0, 100.0),
    "sharpening": (0.0, 150.0),
    "sharpen_radius": (0.5, 3.0),
    "sharpen_detail": (0.0, 100.0),
    "sharpen_masking": (0.0, 100.0),
    "noise_reduction": (0.0, 100.0),
    "noise_reduction_detail": (0.0, 100.0),
    "noise_reduction_contrast": (0.0, 100.0),
    "color_noise_reduction": (0.0, 100.0),
    "color_noise_reduction_detail": (0.0, 100.0),
    "color_noise_reduction_smoothness": (0.0, 100.0),
    "vignette": (-100.0, 100.0),
    "vignette_midpoint": (0.0, 100.0),
    "vignette_roundness": (-100.0, 100.0),
    "vignette_feather": (0.0, 100.0),
    "vignette_highlights": (0.0, 100.0),
    "grain": (0.0, 100.0),
    "grain_size": (0.0, 100.0),
    "grain_roughness": (0.0, 100.0),
}
RELATIVE, KELVIN = (-100.0, 100.0), 500.0


def in_range(settings: Column, raw: Column | None = None) -> Column:
    """Known settings, each held to its range, to four digits; unknown ones are dropped.

    `raw` says whether the file is raw; where it is null or not given, it is taken to be. For other files temperatures
    are held to the relative range, and dropped if they look like Kelvin."""
    relative = F.lit(False) if raw is None else F.coalesce(~raw, F.lit(False))
    warmth = lambda k: (k == "temperature") & relative
    low = F.create_map(*(F.lit(x) for k, (a, _) in RANGES.items() for x in (k, a)))
    high = F.create_map(*(F.lit(x) for k, (_, b) in RANGES.items() for x in (k, b)))
    known = F.map_filter(settings, lambda k, v: k.isin(*RANGES) & v.isNotNull() & ~(warmth(k) & (F.abs(v) > KELVIN)))
    least = lambda k: F.when(warmth(k), RELATIVE[0]).otherwise(F.element_at(low, k))
    most = lambda k: F.when(warmth(k), RELATIVE[1]).otherwise(F.element_at(high, k))
    return F.transform_values(known, lambda k, v: round_away(F.greatest(least(k), F.least(most(k), v)), 4))


def cropped(crop: Column) -> tuple[Column, Column]:
    """(edges and angle as a map, reasons) of a map of numbers.

    Edges are left, right, top and bottom, 0 to 1; where none is given, they come from x, y, width and height if all
    four are. A pair of edges that isn't in order, or of which one is missing, is dropped. The angle may be called
    rotation."""

    def once(value: Column, use) -> Column:
        """`use` of a value that is computed once, however often it is named."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def at(c: Column, key: str, low: float = 0.0, high: float = 1.0) -> Column:
        return once(F.try_element_at(c, F.lit(key)).cast("double"), lambda x: round_away(clamp(x, low, high), 4))

    def read(c: Column) -> Column:
        angle = F.coalesce(at(c, "angle", -45.0, 45.0), at(c, "rotation", -45.0, 45.0))
        return F.struct(*(at(c, k).alias(k) for k in ("left", "right", "top", "bottom", "x", "y", "width", "height")), angle.alias("angle"))

    def edged(r: Column) -> Column:
        boxed = F.coalesce(r["left"], r["right"], r["top"], r["bottom"]).isNull() & (r["x"] + r["y"] + r["width"] + r["height"]).isNotNull()
        far = lambda a, b: F.least(F.lit(1.0), round_away(r[a] + r[b], 4))
        whole = {"left": r["x"], "right": far("x", "width"), "top": r["y"], "bottom": far("y", "height")}
        return F.struct(*(F.when(boxed, w).otherwise(r[k]).alias(k) for k, w in whole.items()), r["angle"].alias("angle"))

    def fitted(e: Column) -> Column:
        parts, reasons = [], []
        for a, b in (("left", "right"), ("top", "bottom")):
            fit = e[a] < e[b]  # null if one is missing
            reasons.append(F.when(~fit, f"{a}_not_before_{b}"))
            parts += [F.lit(a), F.when(fit, e[a]), F.lit(b), F.when(fit, e[b])]
        edges = F.map_filter(F.create_map(*parts, F.lit("angle"), e["angle"]), lambda k, v: v.isNotNull())
        return F.struct(edges.alias("edges"), F.array_compact(F.array(*reasons)).alias("reasons"))

    both = once(once(once(crop, read), edged), fitted)
    return both["edges"], both["reasons"]


def restricted_temperature(winners: DataFrame, by: list[str]) -> DataFrame:
    """(by, temperature, matching, winners): the blended temperature of winners(by, score, settings, raw, query_raw).

    Kelvin and relative values can't be averaged, so only winners whose raw flag is the query's count; an unknown flag
    on either side fits all. A winner without a temperature counts as zero. Null where no winner has one, or none fits."""
    fits = F.coalesce(F.col("raw") == F.col("query_raw"), F.lit(True))
    value = F.try_element_at("settings", F.lit("temperature"))
    weight = F.sum(F.when(fits, F.col("score")))
    rolled = winners.groupBy(*by).agg(
        F.max(value.isNotNull()).alias("has"), weight.alias("weight"), F.coalesce(F.sum(F.when(fits, F.col("score") * value)), F.lit(0.0)).alias("sum"),
        F.count_if(fits).alias("matching"), F.count("*").alias("winners"),
    )
    blend = F.when(F.col("has") & (F.col("weight") > 0), round_away(F.col("sum") / F.nullif(F.col("weight"), F.lit(0.0)), 1))
    return rolled.select(*by, blend.alias("temperature"), "matching", "winners")


# Confidence below which a result is weak or only moderate, and the squared distance of recent examples.
WEAK, MODERATE, RECENT = 0.45, 0.70, 0.5


def recent(training: DataFrame, k: int = POOL, captured: str = "captured_at", id_: str = "id") -> DataFrame:
    """The k latest examples, for a photo without a vector: all at one distance, undated ones last."""
    return training.orderBy(F.desc(F.coalesce(captured, F.lit(""))), id_).limit(k).withColumn("distance", F.lit(RECENT))


def outcome(scored: DataFrame, requests: DataFrame, training: int) -> DataFrame:
    """(request, engine, confidence, matched, names, warning) for each of requests(request).

    Of scored(request, score, id, name), some dozens for a request, the best WINNERS are matched, of equal ones the
    smallest id. One without a name is called by its label, if scored has such a column, and else by its id. Fewer than ENOUGH training rows, or none found, give no result; confidence is the best score."""
    best = Window.partitionBy("request").orderBy(F.desc("score"), "id")
    won = scored.select("*", F.row_number().over(best).alias("at")).filter(F.col("at") <= WINNERS)
    called = F.coalesce("name", *(["label"] if "label" in scored.columns else []), F.col("id").cast("string"))
    rolled = won.groupBy("request").agg(round_away(F.max("score"), 3).alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", called.alias("name")))).alias("listed"))
    enough = F.lit(training >= ENOUGH)
    some = enough & F.col("n").isNotNull()
    warning = (
        F.when(~enough, "too_few_examples").when(~some, "nothing_found").when(F.col("best") < WEAK, "low_confidence").when(F.col("best") < MODERATE, "moderate_confidence")
    )
    return requests.select("request").distinct().join(rolled, "request", "left").select(
        "request",
        F.when(some, "style").otherwise("none").alias("engine"),
        F.when(some, F.col("best")).otherwise(0.0).alias("confidence"),
        F.when(some, F.col("n")).otherwise(0).alias("matched"),
        F.when(some, F.col("listed.name")).otherwise(F.array().cast("array<string>")).alias("names"),
        warning.alias("warning"),
    )


# What each control of a user allows to be changed.
CONTROLS = {
    "adjust_white_balance": ("temperature", "tint", "white_balance"),
    "adjust_basic_tone": ("exposure", "contrast", "highlights", "shadows", "whites", "blacks"),
    "adjust_presence": ("texture", "clarity", "dehaze"),
    "adjust_color_mix": ("vibrance", "saturation", "hsl"),
    "do_color_grading": ("color_grading",),
    "use_tone_curve": ("tone_curve",),
    "adjust_detail": (
        "sharpening", "sharpen_radius", "sharpen_detail", "sharpen_masking", "noise_reduction", "noise_reduction_detail", "noise_reduction_contrast",
        "color_noise_reduction", "color_noise_reduction_detail", "color_noise_reduction_smoothness",
    ),
    "adjust_effects": (
        "vignette", "vignette_midpoint", "vignette_roundness", "vignette_feather", "vignette_highlights", "grain", "grain_size", "grain_roughness",
    ),
    "adjust_lens_corrections": ("lens_corrections",),
    "allow_auto_crop": ("crop",),
}


def controlled(settings: Column, controls: Column) -> Column:
    """Settings less those whose control is false in a map of booleans; a control that isn't there is on."""
    is_off = lambda name: ~F.coalesce(F.try_element_at(controls, F.lit(name)), F.lit(True))
    off = F.flatten(F.array(*(F.when(is_off(name), F.lit(list(keys))).otherwise(F.array().cast("array<string>")) for name, keys in CONTROLS.items())))
    return F.map_filter(settings, lambda k, v: ~F.array_contains(off, k))


def allowed(settings: Column, off: list[str]) -> Column:
    return F.map_filter(settings, lambda k, v: ~k.isin(*off)) if off else settings

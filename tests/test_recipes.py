"""Recipes as models write them, in every shape."""

import json

import pytest

from lumenlake.operators import recipes


def normalized(spark, *given, raw=None):
    rows = [(i, r if r is None or isinstance(r, str) else json.dumps(r), raw) for i, r in enumerate(given)]
    out = recipes.normalized(spark.createDataFrame(rows, "id int, recipe string, raw boolean"), raw="raw")
    assert out.columns == ["id", "raw", "normalized"]
    return [r.normalized for r in sorted(out.collect(), key=lambda r: r.id)]


def test_not_a_recipe(spark):
    for r in normalized(spark, None, "", "{broken", "[1]", '"x"', "null"):
        assert (r.summary, r.settings, r.masks, r.warnings) == ("", {}, [], [recipes.INVALID])
    (empty,) = normalized(spark, {})
    assert (empty.summary, empty.settings, empty.curves, empty.warnings) == (recipes.UNNAMED, {}, {}, [])


def test_numbers_in_any_dress(spark):
    (r,) = normalized(spark, {"global": {"exposure": " 9 ", "contrast": True, "shadows": "12abc", "whites": None, "blacks": [1], "clarity": "1e1", "tint": 0.12345, "unheard_of": 3, "vibrance": "true", "dehaze": "1d"}})
    assert r.settings == {"exposure": 5.0, "contrast": 1.0, "clarity": 10.0, "tint": 0.1235}


def test_white_balance_and_kelvin(spark):
    wb = {"global": {"temperature": 5200, "white_balance": {"temperature": 30, "tint": 200}}}
    (raw,), (other,) = normalized(spark, wb), normalized(spark, wb, raw=False)
    assert raw.settings == {"temperature": 5200.0, "tint": 150.0} and raw.warnings == []
    assert other.settings == {"temperature": 30.0, "tint": 150.0} and other.warnings == [recipes.IN_KELVIN]


def test_crops(spark):
    crop = lambda **c: {"global": {"crop": c}}
    a, b, c, d = normalized(spark, crop(x=0.1, y=0.2, width=0.5, height=0.9, rotation=60), crop(left=0.6, right=0.2), crop(nothing=1), {"global": {"crop": 3}})
    assert a.crop == {"left": 0.1, "right": 0.6, "top": 0.2, "bottom": 1.0, "angle": 45.0}
    assert b.crop == {} and b.warnings == [recipes.CROP_ORDER["left_not_before_right"], recipes.NO_CROP]
    assert c.warnings == [recipes.NO_CROP] and d.warnings == []


@pytest.mark.parametrize(
    "given,kept",
    [
        ([0, 0, 255, 300], [0, 0, 255, 255]),
        ([0, "1.5", 200, 210, 9], [0, 2, 200, 210]),
        ([{"x": 0, "y": 4}, {"x": 1}, {"x": 2, "y": True}], [0, 4, 2, 1]),
        ([[0, 1], [2], [3, 4, 5]], [0, 1, 3, 4]),
        ([[0, 1], 7], None),
        ([1, 2, 3], None),
        ([1], None),
        ("1, 2, 3, 4", None),
        ([], None),
    ],
)
def test_curves(spark, given, kept):
    (r,) = normalized(spark, {"global": {"tone_curve": {"lights": 500, "shadow_split": -4, "point_curve": {"red": given, "violet": [0, 0, 1, 1]}, "extended_point_curve": {"master": [0, 5000, 4000, 1]}}}})
    assert r.curves == ({} if kept is None else {"red": kept})
    assert r.extended_curves == {"master": [0, 4096, 4000, 1]} and r.tones == {"lights": 100.0, "shadow_split": 0.0}


def test_colours(spark):
    (r,) = normalized(spark, {"global": {
        "hsl": {"red": {"hue": 400, "sheen": 1}, "pink": {"hue": 1}, "blue": {"sheen": 1}, "aqua": 5},
        "color_grading": {"shadows": {"hue": 400, "luminance": -5}, "global": {"hue": 20, "luminance": 7}, "midtones": {}, "blending": -1, "balance": -500},
    }})
    assert r.hsl == {"red": {"hue": 100.0}}
    assert r.grading == {"shadows": {"hue": 360.0, "luminance": -5.0}, "global": {"hue": 20.0}} and r.grading_levels == {"blending": 0.0, "balance": -100.0}


def test_masks_and_warnings(spark):
    masks = [
        5, {}, {"kind": "Moon"}, {"kind": " Sky "}, {"kind": "sky", "adjustments": {"glow": 1}},
        {"kind": "SUBJECT", "adjustments": {"exposure": 9, "temperature": 5000, "glow": 1}, "name": " Her ", "invert": True}, {"kind": "background", "adjustments": {"noise": "3"}, "invert": "true", "name": 4},
    ]
    (r,) = normalized(spark, {"summary": " warm ", "warnings": [" careful ", "", 4], "masks": masks})
    assert [(m.kind, m.adjustments, m.name, m.invert) for m in r.masks] == [("subject", {"exposure": 5.0, "temperature": 100.0}, "Her", True), ("background", {"noise": 3.0}, None, None)]
    assert r.summary == "warm" and r.warnings == [
        "careful", "Ignored mask #1: expected an object.", "Ignored mask #2: unsupported kind 'unknown'.", "Ignored mask #3: unsupported kind 'moon'.",
        "Ignored mask 'sky': adjustments were missing.", "Ignored mask 'sky': no supported adjustments were returned.",
    ]


def test_clashing_names(spark):
    """Columns named like those used within stay as they are."""
    d = spark.createDataFrame([(1, "{}", "x", {"a": 1})], "kept int, recipe string, raw string, d map<string,int>")
    out = recipes.normalized(d).first()
    assert (out.kept, out.raw, out.d) == (1, "x", {"a": 1}) and out.normalized.summary == recipes.UNNAMED
    assert recipes.normalized(d.limit(0).select("recipe")).columns == ["normalized"]

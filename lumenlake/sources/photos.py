"""Landing rows (id, vector, metadata as a JSON object in a string) into typed columns.

Hot keys become columns, so filters and pruning reach the files; the object itself is kept as a variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.scalar import photo_id, string_set

# Keys of the metadata that become columns, by type.
DOUBLES = (
    "capture_time", "exposure_bias", "cull_sharpness", "cull_exposure", "cull_noise", "cull_highlight_clip", "cull_shadow_clip", "cull_technical_score", "cull_aesthetic", "cull_sharpness_peak", "cull_focus_concentration",
    "cull_sharp_region_x", "cull_sharp_region_y", "cull_motion_anisotropy", "cull_face_sharpness", "cull_face_prominence", "cull_face_visibility", "cull_face_score", "cull_eye_openness", "cull_blink_penalty", "cull_occlusion",
)
STRINGS = ("photo_id", "uuid", "filename", "run_date", "provider", "model", "title", "caption", "alt_text", "keywords", "cull_phash", "phash", "face_model", "species_model", "catalog_ids")
BOOLEANS = ("has_embedding", "is_raw", "faces_checked", "species_checked", "cull_faces_present")
LONGS = ("cull_face_count", "tokens_used")


def validated(rows: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector is missing or has the right length, and the others."""
    fits = F.coalesce(F.size("vector") == dimensions, F.lit(True)) | F.col("vector").isNull()
    return rows.filter(fits), rows.filter(~fits)


def promoted(rows: DataFrame) -> DataFrame:
    """`rows` with typed columns for metadata; what isn't a JSON object counts as an empty one."""
    meta = rows.withColumn("extra", F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}"))))

    def read(kind: str, keys: tuple[str, ...]) -> list:
        return [F.try_variant_get("extra", f"$.{k}", kind).alias(k) for k in keys]

    flags = [F.coalesce(F.try_variant_get("extra", f"$.{k}", "boolean"), F.try_variant_get("extra", f"$.{k}", "string") == "true").alias(k) for k in BOOLEANS]
    typed = meta.select("id", "vector", "extra", *read("double", DOUBLES), *read("string", STRINGS), *flags, *read("long", LONGS))
    return typed.withColumns(
        {"catalogs": string_set(F.col("catalog_ids")), "has_embedding": F.coalesce("has_embedding", F.lit(True)), "photo_id": photo_id(F.col("photo_id"), F.col("uuid"))}
    ).drop("catalog_ids")

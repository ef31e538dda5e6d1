"""Catalog upkeep: scans, upserts, merges, deletions, ownership, delta checks and statistics.

Tables are Parquet without transactions, so every change is a DataFrame that the caller writes over its old state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNASSIGNED = "_unassigned"


def get(df: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    """Rows of the ids asked for, each once; unknown ids are left out."""
    return df.join(ids.select(id_).distinct(), id_, "left_semi")


def by_prefix(df: DataFrame, prefix: str, id_: str = "id") -> DataFrame:
    """Ids that begin with the prefix; `_` and `%` in it are themselves."""
    return df.filter(F.col(id_).startswith(prefix))


def without_prefix(df: DataFrame, prefix: str, id_: str = "id") -> DataFrame:
    return df.filter(~F.coalesce(F.col(id_).startswith(prefix), F.lit(False)))


def last_of(df: DataFrame, id_: str, order: str) -> DataFrame:
    """The row of each id that comes last by `order`."""
    newest = Window.partitionBy(id_).orderBy(F.col(order).desc())
    return df.select("*", F.row_number().over(newest).alias("__n")).filter("__n = 1").drop("__n")


def upserted(old: DataFrame, new: DataFrame, id_: str = "id") -> DataFrame:
    """Rows of `new` replace those of the same id whole; others are added. Ids of `new` are unique (see last_of)."""
    return old.join(new.select(id_), id_, "left_anti").unionByName(new)


def merged(old: DataFrame, new: DataFrame, id_: str = "id") -> DataFrame:
    """Values of `new` that aren't null are laid over the row of the same id."""
    columns = [c for c in old.columns if c != id_]
    o, n = old.alias("o"), new.alias("n")
    over = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in columns]
    return o.join(n, F.col(f"o.{id_}") == F.col(f"n.{id_}"), "full_outer").select(F.coalesce(f"n.{id_}", f"o.{id_}").alias(id_), *over)


def deleted(df: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    return df.join(ids.select(id_).distinct(), id_, "left_anti")


def claimed(df: DataFrame, ids: DataFrame, catalog: str, id_: str = "id") -> DataFrame:
    """The catalog is added to the set of the ids asked for."""
    asked = ids.select(F.col(id_).alias("__asked")).distinct()
    owned = F.array_sort(F.array_union("catalogs", F.array(F.lit(catalog))))
    return df.join(asked, F.col(id_) == F.col("__asked"), "left").withColumn(
        "catalogs", F.when(F.col("__asked").isNotNull(), owned).otherwise(F.col("catalogs"))
    ).drop("__asked")


def released(df: DataFrame, active: DataFrame, catalog: str, id_: str = "id") -> DataFrame:
    """The catalog is taken from the set of all ids that aren't active; no row goes."""
    kept = active.select(F.col(id_).alias("__active")).distinct()
    return df.join(kept, F.col(id_) == F.col("__active"), "left").withColumn(
        "catalogs", F.when(F.col("__active").isNull(), F.array_remove("catalogs", catalog)).otherwise(F.col("catalogs"))
    ).drop("__active")


def unprocessed(asked: DataFrame, *tables: tuple[DataFrame, Column], id_: str = "id", order: str = "position") -> DataFrame:
    """The ids of asked(id, position) that lack any of the given work, in the order asked.

    Each table comes with what makes a row of it done; an id without a row isn't done."""
    out, todo = asked, F.lit(False)
    for i, (table, done) in enumerate(tables):
        flag = table.select(F.col(id_).alias(f"__id{i}"), done.alias(f"__done{i}"))
        out = out.join(flag, F.col(id_) == F.col(f"__id{i}"), "left")
        todo = todo | ~F.coalesce(F.col(f"__done{i}"), F.lit(False))
    return out.filter(todo).select(id_, order).orderBy(order)


def unprocessed_photos(
    asked: DataFrame, photos: DataFrame, faces: DataFrame, cloud: DataFrame, tasks: list[str], *,
    regenerate: bool = True, owner: str | None = None, face_model: str = "", species_model: str | None = None,
) -> DataFrame:
    """The ids of asked(id, position) that any of the tasks is still to be done for, in the order asked.

    Tasks are embeddings, metadata, faces, vertexai, species and cull; unknown ones ask for nothing. With `regenerate`
    all is done anew. Each photo of photos(id, ...) has its flags as strings, null where the key is missing; of photos
    with catalogs only those of `owner` count, if that is given. faces(face_id) are stored faces, cloud(id) photos with
    a vector made elsewhere. Faces and species found by another model than the present one are outstanding;
    `species_model` is null where none is loaded, and then what is stored is taken as it is."""
    known = {"embeddings", "metadata", "faces", "vertexai", "species", "cull"} & set(tasks)
    if regenerate:
        return (asked if known else asked.limit(0)).select("id", "position").orderBy("position")
    own = photos.filter(F.array_contains("catalogs", owner)) if owner else photos
    held = faces.select(F.regexp_extract("face_id", r"^(.*)_[^_]*$", 1).alias("__face")).distinct()
    away = cloud.select(F.col("id").cast("string").alias("__cloud")).distinct()
    own = own.drop("catalogs").withColumnRenamed("id", "__id").withColumn("__there", F.lit(True))
    rows = asked.join(own, F.col("id") == F.col("__id"), "left").join(held, F.col("id").cast("string") == F.col("__face"), "left").join(away, F.col("id").cast("string") == F.col("__cloud"), "left")
    flag = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    checked = F.col("__face").isNotNull() | F.coalesce(F.col("faces_checked") == "true", F.lit(False))
    done = {
        "embeddings": flag("has_embedding"),
        "metadata": flag("title") | flag("caption") | flag("alt_text") | flag("keywords"),
        "faces": checked & F.coalesce(F.col("face_model") == face_model, F.lit(False)),
        "vertexai": F.col("__cloud").isNotNull(),
        "cull": F.col("cull_faces_present").isNotNull(),
        "species": flag("species_checked") & (F.coalesce(F.col("species_model") == species_model, F.lit(False)) if species_model is not None else F.lit(True)),
    }
    todo = ~flag("cull_phash") if known else F.lit(False)
    for task in sorted(known):
        todo = todo | ~done[task]
    return rows.filter(todo).select("id", "position").orderBy("position")


# Keys of what a model has made of a photo.
AI_KEYS = (
    "title", "caption", "keywords", "alt_text", "model", "run_date", "tokens_used", "flattened_keywords", "edit_recipe", "edit_summary", "edit_warnings",
    "edit_model", "edit_provider", "edit_run_date", "species_taxonomy", "species_rank", "species_scientific_name", "species_common_name", "species_confidence",
    "species_alternatives", "species_checked", "species_model",
)


def cleared(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """photos(id, metadata, ...) whose ids are asked for lose the keys of AI_KEYS from their metadata, a map of strings.

    Rows and vectors stay, so the photos count as unprocessed and stay searchable."""
    asked = ids.select(F.col("id").alias("__asked")).distinct()
    left = F.map_filter("metadata", lambda k, v: ~k.isin(*AI_KEYS))
    marked = photos.join(asked, F.col("id") == F.col("__asked"), "left")
    return marked.withColumn("metadata", F.when(F.col("__asked").isNotNull(), left).otherwise(F.col("metadata"))).drop("__asked")


def photo_data(photos: DataFrame, ids: DataFrame, owner: str | None = None) -> DataFrame:
    """What is known of the photos asked for, of photos(id, catalogs, metadata): one row each, none for unknown ids or
    photos of other catalogs.

    JSON texts are parsed; a recipe or warnings that can't be are left out, as are keywords. `species` is null for a
    photo that was never checked, which is not the same as one in which nothing was found."""
    own = get(photos, ids)
    own = own.filter(F.array_contains("catalogs", owner.strip())) if owner is not None else own
    at = lambda k: F.try_element_at("metadata", F.lit(k))
    species = F.struct(*(at(f"species_{k}").alias(k) for k in ("rank", "taxonomy", "scientific_name", "common_name", "confidence", "alternatives", "model")))
    return own.select(
        "id",
        at("title").alias("title"), at("caption").alias("caption"), at("alt_text").alias("alt_text"),
        F.from_json(at("keywords"), "array<string>").alias("keywords"),
        F.when(F.map_contains_key("metadata", "species_checked"), species).alias("species"),
        F.when(F.try_parse_json(at("edit_recipe")).isNotNull(), at("edit_recipe")).alias("edit"),
        at("edit_summary").alias("edit_summary"),
        F.coalesce(F.from_json(at("edit_warnings"), "array<string>"), F.array().cast("array<string>")).alias("edit_warnings"),
        at("edit_model").alias("edit_model"), at("edit_run_date").alias("edit_rundate"), at("model").alias("ai_model"), at("run_date").alias("ai_rundate"),
    )


def replayed(log: DataFrame) -> DataFrame:
    """(id, vector) after log(id, seq, op, vector): the last operation that carries a vector or deletes decides."""
    last = log.filter("op = 'delete' OR vector IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("op", "vector"), "seq").alias("last"))
    return last.select("id", F.when(F.col("last.op") != "delete", F.col("last.vector")).alias("vector"))


def pivoted(eav: DataFrame) -> DataFrame:
    """(id, key, value) of typed entries (id, key, s, b, i, f): a string before a boolean, integer and float."""
    value = F.coalesce("s", F.col("b").cast("string"), F.col("i").cast("string"), F.col("f").cast("string"))
    return eav.filter(~F.col("key").startswith("chroma:")).select("id", "key", value.alias("value"))


def person_key(person: Column) -> Column:
    """The three ways to say that a face has nobody are one."""
    return F.when(F.coalesce(person, F.lit("")).isin("", "_unassigned", "person_unassigned"), F.lit(UNASSIGNED)).otherwise(person)


def persons(faces: DataFrame, names: DataFrame) -> DataFrame:
    """One row per person of faces(face_id, photo_id, person, manual, quality, thumbnail): counts, name, best thumbnail.

    The best is that of the highest quality, of equal ones the first by face_id, whatever its type."""
    shown = F.when(F.coalesce(F.trim("thumbnail"), F.lit("")) != "", F.struct(F.col("quality").isNull().alias("unknown"), (-F.col("quality")).alias("q"), "face_id"))
    rolled = (
        faces.withColumn("person", person_key(F.col("person")))
        .groupBy("person")
        .agg(
            F.count("*").alias("faces"),
            F.count_if(F.coalesce("manual", F.lit(False))).alias("manual"),
            F.count_distinct("photo_id").alias("photos"),
            F.min_by("thumbnail", shown).alias("thumbnail"),
        )
    )
    return rolled.join(names, "person", "left").select("person", "name", "faces", "manual", "photos", "thumbnail")


def rolled_faces(faces: DataFrame) -> DataFrame:
    """Per photo of faces(photo_id, area, sharpness, visibility, eye, occlusion): the worst of prominent faces counts.

    Prominent are those of at least a quarter of the largest's area."""
    largest = F.max("area").over(Window.partitionBy("photo_id"))
    marked = faces.withColumn("prominent", F.col("area") >= 0.25 * largest)
    return marked.groupBy("photo_id").agg(
        F.count("*").alias("face_count"),
        F.max("sharpness").alias("sharpness"),
        F.max(F.least(F.lit(1.0), F.col("area") / 0.12)).alias("prominence"),
        F.avg("visibility").alias("visibility"),
        F.min(F.when(F.col("prominent"), F.col("eye"))).alias("eye"),
        F.max(F.when(F.col("prominent"), F.coalesce("occlusion", F.lit(0.0)))).alias("occlusion"),
    )

"""People as edited by hand: faces moved, persons merged and named, faces found anew, and pages of a person's faces.

Faces are rows (face_id, person, manual, ...). Every edit gives whole tables for the caller to write; `manual` marks what
was decided by hand, which clustering doesn't undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.scalar import unit
from lumenlake.functions.vector import cosine_or_one

NOBODY = ("", "_unassigned", "person_unassigned")
#: Cosine distance within which two detections are one face. Fixed value.
SAME_FACE = 0.2


def quality(detection: Column, sharpness: Column, occlusion: Column, area: Column) -> Column:
    """What a face is worth as an example of its person; what wasn't measured counts as zero. Fixed weights."""
    known = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in (detection, sharpness, occlusion, area)]
    return 0.4 * known[0] + 0.3 * known[1] + 0.2 * (1 - known[2]) + 0.1 * unit(known[3] / 0.12)


def page(faces: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """One page of faces(face_id, distance, quality, ...): `typical` begins next to the centroid, `outlier` far from it,
    `quality` with the best. Faces without a distance come last; of equal ones the smaller face_id first."""
    orders = {
        "typical": [F.asc_nulls_last("distance"), F.desc("quality")],
        "outlier": [F.desc_nulls_last("distance"), F.asc("quality")],
        "quality": [F.desc("quality")],
    }
    return faces.orderBy(*orders[order], "face_id").offset(offset).limit(limit)


def next_person(faces: DataFrame, names: DataFrame) -> str:
    """The first number above all that faces or names use."""
    number = F.regexp_extract("person", r"^person_(\d{1,18})$", 1)
    used = faces.select("person").unionByName(names.select("person")).select(number.alias("n")).filter("n <> ''")
    last = used.agg(F.max(F.col("n").cast("long"))).first()[0]
    return f"person_{0 if last is None else last + 1}"


def assigned(faces: DataFrame, ids: DataFrame, person: str | None) -> DataFrame:
    """The faces asked for belong to `person`, or to nobody if that is empty, and are marked as decided by hand."""
    target = "person_unassigned" if (person or "") in NOBODY else person
    asked = ids.select(F.col("face_id").alias("__asked")).distinct()
    moved = F.col("__asked").isNotNull()
    return (
        faces.join(asked, F.col("face_id") == F.col("__asked"), "left")
        .withColumn("person", F.when(moved, F.lit(target)).otherwise(F.col("person")))
        .withColumn("manual", moved | F.coalesce("manual", F.lit(False)))
        .drop("__asked")
    )


def missing(faces: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids asked for that no face has, each once."""
    return ids.select("face_id").distinct().join(faces, "face_id", "left_anti")


def merged_persons(faces: DataFrame, names: DataFrame, persons: list[str], into: str | None = None, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Faces and names(person, name) after several persons became one, all of whose faces are decided by hand.

    That one is `into` if it is among them, else the one with most faces, of equal ones the smallest. It is called
    `name`, else as before, else as the first of the others that had a name. Less than two persons are an error."""
    asked = sorted({p.strip() for p in persons} - set(NOBODY))
    if len(asked) < 2:
        raise ValueError("merging takes two persons or more")
    held = faces.filter(F.col("person").isin(*asked))
    most = held.groupBy("person").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person").first()
    if most is None:
        return faces, names
    target = into.strip() if into and into.strip() in asked else most["person"]
    inside = F.coalesce(F.col("person").isin(*asked), F.lit(False))
    after = faces.withColumn("manual", inside | F.coalesce("manual", F.lit(False))).withColumn("person", F.when(inside, F.lit(target)).otherwise(F.col("person")))
    if name and name.strip():
        called = names.sparkSession.createDataFrame([(target, name.strip())], "person string, name string")
    else:
        first = names.filter(inside).orderBy(F.desc(F.col("person") == target), "person").limit(1)
        called = first.select(F.lit(target).alias("person"), "name")
    return after, names.filter(~inside).unionByName(called)


def named(faces: DataFrame, names: DataFrame, person: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Faces and names after a person got a name, which also confirms all its faces.

    A blank name is taken away; what was confirmed stays so."""
    rest, called = names.filter(F.col("person") != person), name.strip()
    if not called:
        return faces, rest
    after = rest.unionByName(names.sparkSession.createDataFrame([(person, called)], "person string, name string"))
    if person in NOBODY:
        return faces, after
    return faces.withColumn("manual", F.coalesce(F.col("person") == person, F.lit(False)) | F.coalesce("manual", F.lit(False))), after


def carried_over(found: DataFrame, old: DataFrame, model: str, within: float = SAME_FACE) -> DataFrame:
    """found(photo_id, at, vector, ...) with person and manual of the old faces of their photos that they are.

    Pairs within a cosine distance are taken from the nearest on, of equal ones by `at` and the old face_id, each side
    once. Of old(photo_id, face_id, vector, person, manual, model) only faces of the present model count, and of those
    without a person only those where that was decided by hand. Pairs meet within a photo, so a fold has dozens of them;
    other faces have an empty person."""
    manual = F.coalesce("manual", F.lit(False))
    known = old.filter((F.col("model") == model) & F.col("vector").isNotNull() & (manual | (F.coalesce("person", F.lit("")) != "")))
    former = known.select("photo_id", "face_id", F.col("vector").alias("was"), F.coalesce("person", F.lit("")).alias("person"), manual.alias("manual"))
    near = found.select("photo_id", "at", "vector").join(former, "photo_id").withColumn("distance", cosine_or_one(F.col("vector"), F.col("was"))).filter(F.col("distance") <= within)
    listed = near.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("distance", "at", "face_id", "person", "manual"))).alias("pairs"))
    taken = lambda kept, p: F.exists(kept, lambda k: (k["at"] == p["at"]) | (k["face_id"] == p["face_id"]))
    chosen = F.aggregate("pairs", F.slice("pairs", 1, 0), lambda kept, p: F.when(taken(kept, p), kept).otherwise(F.concat(kept, F.array(p))))
    each = listed.select("photo_id", F.explode(chosen).alias("p")).select("photo_id", "p.at", "p.person", "p.manual")
    return found.join(each, ["photo_id", "at"], "left").withColumn("person", F.coalesce("person", F.lit(""))).withColumn("manual", F.coalesce("manual", F.lit(False)))


def redetected(old: DataFrame, photos: DataFrame, found: DataFrame, model: str) -> DataFrame:
    """The face table after `photos` were searched anew: their old faces go, those found come with what carries over.

    A photo in which nothing was found now has no faces; face_id is the photo's id and the place among its faces."""
    fresh = carried_over(found, old, model).withColumn("face_id", F.concat_ws("_", F.col("photo_id").cast("string"), F.col("at").cast("string"))).withColumn("model", F.lit(model))
    return old.join(photos.select("photo_id").distinct(), "photo_id", "left_anti").unionByName(fresh.select(*old.columns))

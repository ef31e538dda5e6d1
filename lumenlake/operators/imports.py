"""Imports of metadata and of old stores, with outcomes: what failed is a table of its own, and counts are observed in the
pass that writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lumenlake.functions.scalar import photo_id, string_set
from lumenlake.operators import trees
from lumenlake.plans.lineage import materialized

# Texts that an item may bring, besides keywords.
TEXTS = ("title", "caption", "alt_text")


def judged_items(items: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Items with their outcome, and how many were imported and failed, counted while they are written.

    items(position, item), item being JSON. Rows: (position, id, uuid, outcome, changes): outcome is imported, no object,
    no id or no metadata; changes are a map of texts. Keywords count unless they are null or empty, as JSON and flattened;
    other fields if they are texts that aren't empty."""
    parsed = items.select("position", F.try_parse_json("item").alias("v")).withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    value = lambda f: F.when(F.col("is_object"), F.try_variant_get("v", f"$.{f}", "variant"))
    text = lambda f: F.when(F.schema_of_variant(value(f)) == "STRING", F.try_variant_get("v", f"$.{f}", "string"))
    keywords = value("keywords")
    held = ~F.to_json(keywords).isin("[]", "{}", "null") & keywords.isNotNull()
    known = materialized(
        parsed.select("position", "is_object", F.coalesce(text("photo_id"), text("uuid")).alias("id"), text("uuid").alias("uuid"), F.when(held, F.to_json(keywords)).alias("keywords"), *(F.nullif(text(f), F.lit("")).alias(f) for f in TEXTS)),
        "items",
    )
    flat = trees.flattened(trees.nodes(known.filter("keywords IS NOT NULL").select(F.col("position").alias("id"), F.col("keywords").alias("tree"))))
    rows = known.join(flat.select(F.col("id").alias("of"), F.col("text").alias("flattened")), F.col("position") == F.col("of"), "left")
    changes = F.map_filter(
        F.create_map(F.lit("keywords"), "keywords", F.lit("flattened_keywords"), F.when(F.col("keywords").isNotNull(), F.coalesce("flattened", F.lit(""))), *(x for f in TEXTS for x in (F.lit(f), F.col(f)))),
        lambda k, v: v.isNotNull(),
    )
    outcome = F.when(~F.col("is_object"), "no object").when(F.coalesce("id", F.lit("")) == "", "no id").when(F.size("changes") == 0, "no metadata").otherwise("imported")
    told = rows.withColumn("changes", changes).withColumn("outcome", outcome).select("position", "id", F.coalesce("uuid", "id").alias("uuid"), "outcome", "changes")
    seen = Observation()
    imported = F.col("outcome") == "imported"
    written = materialized(told.observe(seen, F.count_if(imported).alias("imported"), F.count_if(~imported).alias("failed")), "outcomes")
    counts = seen.get
    return written, {k: counts.get(k) or 0 for k in ("imported", "failed")}


def imported(photos: DataFrame, outcomes: DataFrame, run_date: str, catalog: str | None = None) -> DataFrame:
    """photos(id, vector, metadata) once the imported outcomes are laid over them; unknown photos are added, without vectors.

    Items of one photo are laid over each other in their order: of each field the last that was brought stays. Metadata,
    a map of texts, gets the run date, the last item's uuid, an id of its own where it has none, and the catalog among its
    `catalog_ids`, a JSON list."""
    good = outcomes.filter("outcome = 'imported'")
    fields = good.select("id", "position", F.explode("changes").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "position").alias("v"))
    last = good.groupBy("id").agg(F.max_by("uuid", "position").alias("uuid"))
    changed = fields.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("changes")).join(last, "id")
    none = F.create_map().cast("map<string,string>")
    p, c = photos.alias("p"), changed.alias("c")
    whole = p.join(c, F.col("p.id") == F.col("c.id"), "full_outer").select(F.coalesce("p.id", "c.id").alias("id"), "p.vector", F.coalesce("p.metadata", none).alias("metadata"), "c.changes", "c.uuid")
    touched = F.col("changes").isNotNull()
    new = F.map_concat("changes", F.create_map(F.lit("run_date"), F.lit(run_date), F.lit("uuid"), F.col("uuid")))
    laid = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(new, k)), new)
    out = whole.withColumn("metadata", F.when(touched, laid).otherwise(F.col("metadata")))
    at = lambda k: F.try_element_at("metadata", F.lit(k))
    own = F.create_map(F.lit("photo_id"), F.coalesce(photo_id(at("photo_id"), at("uuid")), F.col("id")))
    if catalog is not None:
        ids = F.array_sort(F.array_union(F.coalesce(string_set(at("catalog_ids")), F.array().cast("array<string>")), F.array(F.lit(catalog))))
        own = F.map_concat(own, F.create_map(F.lit("catalog_ids"), F.to_json(ids)))
    put = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(own, k)), own)
    return out.select("id", "vector", F.when(touched, put).otherwise(F.col("metadata")).alias("metadata"))


def migrated(records: DataFrame, log: DataFrame, dimensions: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of an old store, (table, source, migrated, needs_reembedding), and (table, records) of unknown tables.

    records(table, id, vector, has_embedding, metadata) are what was stored, log(table, id, seq, op, vector) what was
    written since: the last entry that brings a vector or deletes decides. A record that claims no vector loses what it has
    (zeros stood for none); one that claims a vector but has none, or one of the wrong length for its table, has
    needs_reembedding. Counts are taken from what was written."""
    last = log.filter("op = 'delete' OR vector IS NOT NULL").groupBy("table", "id").agg(F.max_by(F.struct("op", "vector"), "seq").alias("last"))
    length = F.try_element_at(F.create_map(*(F.lit(x) for pair in dimensions.items() for x in pair)), F.col("table"))
    claims = F.coalesce("has_embedding", F.lit(True))
    now = F.when(F.col("last").isNull(), F.col("vector")).when(F.col("last.op") != "delete", F.col("last.vector"))
    fits = F.coalesce(F.size(now) == length, F.lit(False)) & now.isNotNull()
    known = records.filter(F.col("table").isin(*dimensions))
    rows = known.join(last, ["table", "id"], "left").select("table", "id", F.when(claims & fits, now).alias("vector"), (claims & ~fits).alias("needs_reembedding"), "metadata")
    written = materialized(rows, "migrated")
    source = known.groupBy("table").agg(F.count("*").alias("source"))
    counts = written.groupBy("table").agg(F.count("*").alias("migrated"), F.count_if("needs_reembedding").alias("needs_reembedding"))
    told = source.join(counts, "table", "left").select("table", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("migrated", "needs_reembedding")))
    skipped = records.filter(~F.col("table").isin(*dimensions)).groupBy("table").agg(F.count("*").alias("records"))
    return written, told, skipped


def verified(counts: DataFrame) -> DataFrame:
    """`counts` of a migration; an error if a table holds fewer rows than its source."""
    return counts.withColumn("migrated", F.when(F.col("migrated") >= F.col("source"), F.col("migrated")).otherwise(F.raise_error(F.concat(F.lit("rows are missing in "), "table")).cast("long")))


def in_order(ids: DataFrame) -> DataFrame:
    """ids(position, id), each id once, where it first stands; null and empty ids are left out."""
    first = ids.filter("coalesce(id, '') <> ''").groupBy("id").agg(F.min("position").alias("position"))
    return first.select("position", "id").orderBy("position")


def cached(links: DataFrame, now: str, positive: int, negative: int) -> DataFrame:
    """links(key, resolved, fetched_at, ...) that are still good: found ones for `positive` seconds, misses for `negative`;
    of one key the latest."""
    latest = Window.partitionBy("key").orderBy(F.desc("fetched_at"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros(F.col("fetched_at").cast("timestamp")) / 1e6
    once = links.withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n")
    return once.filter(age < F.when(F.col("resolved"), positive).otherwise(negative))

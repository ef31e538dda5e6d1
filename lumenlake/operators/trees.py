"""Keyword trees: JSON of any depth as rows and back, hierarchies from paths, and labels of categories.

Trees are walked a level a step, all trees at once, and built from the deepest level up in the same way, so a step is a
lateral join or an aggregation and no function sees a whole forest. Each step is written down. Members of objects are
walked in the order of their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.plans.lineage import materialized

# Fields of a keyword that is an object, in the order in which they count, and what stands in them.
FIELDS = {"name": "name", "synonyms": "synonym", "aliases": "alias", "synonym_aliases": "synonym_alias"}
LISTS = tuple(FIELDS)[1:]
#: Levels at most; deeper trees are an error.
DEEPEST = 200


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def quoted(text: Column) -> Column:
    """The JSON string of a text."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").otherwise("other")


def nodes(trees: DataFrame) -> DataFrame:
    """(id, at, key, kind, role, path, text) of trees(id, tree), tree being JSON: a row for each value in it.

    `at` are the places from the root down, `key` is null in arrays; text is that of strings, JSON of numbers and the
    like, null of containers. `path` are the categories above. Roles: root; category (a member of the root or of another
    category); keyword (an item of a list of keywords); the fields of keywords that are objects, and synonym, alias and
    synonym_alias for what is listed there; other. An object with a name is a keyword, not a category. A null tree and
    JSON that can't be parsed have no rows."""
    spark = trees.sparkSession
    none = F.array().cast("array<string>")
    now = trees.select("id", F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("key"), F.lit("root").alias("role"), none.alias("path"), F.try_parse_json("tree").alias("v"))
    now = materialized(now.filter("v IS NOT NULL").withColumn("kind", _kind(F.col("v"))), "tree-level")
    levels = []
    for _ in range(DEEPEST):
        text = F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string")).when(F.col("kind") == "other", F.to_json("v"))
        levels.append(now.select("id", "at", "key", "kind", "role", "path", text.alias("text")))
        inner = now.filter("kind IN ('object', 'array')")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        above = inner.select("id", *(F.col(c).alias(f"above_{c}") for c in ("at", "key", "kind", "role", "path", "v")))
        found = above.lateralJoin(spark.tvf.variant_explode(F.col("above_v").outer()))
        named = F.try_variant_get("above_v", "$.name", "variant").isNotNull()
        a, kind = F.col("above_role"), _kind(F.col("value"))
        is_object = F.col("above_kind") == "object"
        keyword = is_object & ((a == "keyword") | ((a == "category") & named))
        field = reduce(lambda c, f: c.when(F.col("key") == f, f), tuple(FIELDS), F.when(F.lit(False), ""))
        listed = reduce(lambda c, f: c.when(a == f, FIELDS[f]), LISTS, F.when(F.lit(False), ""))
        role = (
            F.when(keyword, F.coalesce(field, F.lit("other")))
            .when(is_object & a.isin("root", "category"), "category")
            .when(~is_object & a.isin("root", "category"), "keyword")
            .when(~is_object, F.coalesce(listed, F.lit("other")))
            .otherwise("other")
        )
        first = F.array_position(F.lit(list(FIELDS)), F.col("key"))  # 0 for other keys
        place = F.when(keyword & (first > 0), first.cast("int") - 1).otherwise(F.col("pos") + len(FIELDS))
        now = materialized(
            found.select(
                "id",
                F.concat("above_at", F.array(place)).alias("at"),
                "key",
                role.alias("role"),
                F.when(a == "category", F.concat("above_path", F.array("above_key"))).otherwise(F.col("above_path")).alias("path"),
                F.col("value").alias("v"),
                kind.alias("kind"),
            ),
            "tree-level",
        )
    raise ValueError(f"trees of more than {DEEPEST} levels")


def keywords(found: DataFrame) -> DataFrame:
    """(id, at, path, name, kind) of nodes: categories, keywords and what is listed with them, each spelling once.

    Of spellings that differ in case only the first counts, in the order of the walk: a category before what is in it, a
    name before its synonyms, aliases and aliases of synonyms. A tree that is one text is that text (kind text)."""
    string = F.col("kind") == "string"
    inner = F.col("role").isin("keyword", "name")
    each = F.array(
        F.when(F.col("role") == "category", F.struct("at", F.col("key").alias("name"), F.lit("category").alias("kind"))),
        F.when(string & (F.col("role") == "category"), F.struct(F.concat("at", F.array(F.lit(0))).alias("at"), F.col("text").alias("name"), F.lit("keyword").alias("kind"))),
        F.when(string & inner, F.struct("at", F.col("text").alias("name"), F.lit("keyword").alias("kind"))),
        F.when(string & F.col("role").isin(*(FIELDS[f] for f in LISTS)), F.struct("at", F.col("text").alias("name"), F.col("role").alias("kind"))),
        F.when(string & (F.col("role") == "root"), F.struct("at", F.col("text").alias("name"), F.lit("text").alias("kind"))),
    )
    rows = found.select("id", "path", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("k")).select("id", "k.at", "path", "k.name", "k.kind")
    rows = rows.withColumn("name", F.when(F.col("kind") == "text", F.col("name")).otherwise(trimmed(F.col("name")))).filter("name <> ''")
    first = Window.partitionBy("id", F.lower("name")).orderBy("at")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def flattened(found: DataFrame) -> DataFrame:
    """(id, text): a tree's keywords, joined by commas; trees without keywords are left out."""
    listed = F.array_sort(F.collect_list(F.struct("at", "name")))
    return keywords(found).groupBy("id").agg(F.array_join(F.transform(listed, lambda k: k["name"]), ", ").alias("text"))


def replaced(found: DataFrame, merges: DataFrame) -> DataFrame:
    """Nodes in which merges(duplicate, canonical, position) are carried out, with a column `changed`.

    Any text that is a duplicate, in whatever case, becomes its canonical form; of texts of one list that are then the
    same, in whatever case, the first stays. Keys aren't texts. Of several forms for one duplicate the last counts; pairs
    that are empty or differ in case only are none. `changed` says that a node was replaced, or that others of its list
    went for it."""
    d, c = trimmed(F.col("duplicate")), trimmed(F.col("canonical"))
    pairs = merges.select(F.lower(d).alias("from"), c.alias("to"), "position").filter("`from` <> '' AND to <> '' AND `from` <> lower(to)")
    last = pairs.groupBy("from").agg(F.max_by("to", F.struct("position", "to")).alias("to"))
    string = F.col("kind") == "string"
    new = found.join(last, string & (F.lower("text") == F.col("from")), "left")
    new = new.withColumn("changed", F.coalesce(F.col("to") != F.col("text"), F.lit(False))).withColumn("text", F.coalesce("to", "text")).drop("from", "to")
    above = F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0)))
    in_list = string & F.col("key").isNull() & (F.size("at") > 0)
    same = Window.partitionBy("id", "above", F.lower("text"))
    listed = new.filter(in_list).withColumn("above", above)
    listed = listed.select("*", F.row_number().over(same.orderBy("at")).alias("n"), F.count("*").over(same).alias("of")).filter("n = 1")
    return new.filter(~in_list).unionByName(listed.withColumn("changed", F.col("changed") | (F.col("of") > 1)).drop("above", "n", "of"))


def assembled(found: DataFrame) -> DataFrame:
    """(id, tree): JSON of nodes(id, at, key, kind, text), members of objects in the order of their keys."""
    rows = materialized(found.select("id", "at", "key", "kind", "text"), "tree-nodes")
    deepest = rows.agg(F.coalesce(F.max(F.size("at")), F.lit(0))).first()[0]
    inner = rows.select("id", "at", F.lit("").alias("inside")).limit(0)
    for depth in range(deepest, -1, -1):
        own = rows.filter(F.size("at") == depth).join(inner, ["id", "at"], "left")
        inside = F.coalesce("inside", F.lit(""))
        json = (
            F.when(F.col("kind") == "string", quoted(F.col("text")))
            .when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}")))
            .when(F.col("kind") == "array", F.concat(F.lit("["), inside, F.lit("]")))
            .otherwise(F.col("text"))
        )
        built = own.select("id", "at", "key", json.alias("json"))
        if depth == 0:
            return built.select("id", F.col("json").alias("tree"))
        member = F.when(F.col("key").isNull(), F.col("json")).otherwise(F.concat(quoted(F.col("key")), F.lit(":"), F.col("json")))
        listed = F.array_sort(F.collect_list(F.struct("key", "at", member.alias("json"))))
        inner = materialized(
            built.groupBy("id", F.slice("at", F.lit(1), F.size("at") - 1).alias("at")).agg(F.array_join(F.transform(listed, lambda m: m["json"]), ",").alias("inside")), "tree-inner"
        )
    return rows.select("id", F.lit("").alias("tree")).limit(0)


def cleaned(texts: Column, reserved: Column) -> Column:
    """A list's texts without blanks around them, each spelling once, none that is empty or among the reserved ones."""
    def add(seen: Column, x: Column) -> Column:
        taken = F.exists(F.concat(reserved, seen), lambda y: F.lower(y) == F.lower(x))
        return F.when((x == "") | taken, seen).otherwise(F.concat(seen, F.array(x)))

    none = F.array().cast("array<string>")
    return F.aggregate(F.transform(F.coalesce(texts, none), trimmed), none, add)


def leaves(found: DataFrame) -> DataFrame:
    """(id, keyword_id, name, path, synonyms, aliases, synonym_aliases) of nodes: the keywords of each tree, kw_1, kw_2 ...

    A keyword that stands as the value of a key has that key in its path, unless they are the same. Keys that are numbers
    aren't categories. A name counts once for each path. Lists are cleaned."""
    string, up = F.col("kind") == "string", lambda n: F.slice("at", F.lit(1), F.size("at") - n)
    plain = found.filter(string & F.col("role").isin("keyword", "category")).select("id", "at", "key", "path", F.col("text").alias("name"), *(F.array().cast("array<string>").alias(f) for f in LISTS))
    held = found.filter(string & F.col("role").isin(*FIELDS.values())).withColumn("of", F.when(F.col("role") == "name", up(1)).otherwise(up(2)))
    lists = (F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == FIELDS[f], F.struct("at", "text")))), lambda x: x["text"]).alias(f) for f in LISTS)
    parts = held.groupBy("id", "of").agg(F.max(F.when(F.col("role") == "name", F.col("text"))).alias("name"), *lists)
    objects = found.filter("kind = 'object'").select("id", F.col("at").alias("of"), "key", "path").join(parts, ["id", "of"]).filter("name IS NOT NULL").withColumnRenamed("of", "at")
    each = plain.unionByName(objects).withColumn("name", trimmed(F.col("name"))).filter("name <> ''")
    whole = F.when(F.col("key").isNotNull() & (F.col("key") != F.col("name")), F.concat("path", F.array("key"))).otherwise(F.col("path"))
    path = F.array_join(F.filter(whole, lambda p: ~p.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")), " > ")
    each = each.withColumn("path", path).withColumn("synonyms", cleaned(F.col("synonyms"), F.array("name"))).withColumn("aliases", cleaned(F.col("aliases"), F.array("name")))
    each = each.withColumn("synonym_aliases", cleaned(F.col("synonym_aliases"), F.concat(F.array("name"), F.col("synonyms"))))
    once = each.withColumn("n", F.row_number().over(Window.partitionBy("id", "path", "name").orderBy("at"))).filter("n = 1")
    numbered = once.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    return numbered.select("id", F.concat(F.lit("kw_"), "n").alias("keyword_id"), "name", "path", *LISTS)


def leaf_json(name: Column, synonyms: Column, aliases: Column, synonym_aliases: Column) -> Column:
    """A keyword as JSON: its name alone, or an object with the lists that aren't empty."""
    fields = (("aliases", aliases), ("name", None), ("synonym_aliases", synonym_aliases), ("synonyms", synonyms))
    parts = [F.concat(F.lit('"name":'), quoted(name)) if c is None else F.when(F.size(c) > 0, F.concat(F.lit(f'"{f}":'), F.to_json(c))) for f, c in fields]
    bare = (F.size(synonyms) <= 0) & (F.size(aliases) <= 0) & (F.size(synonym_aliases) <= 0)
    return F.when(bare, quoted(name)).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def split_path(path: Column) -> Column:
    """The parts of a path written `A > B > C`; categories that are empty are left out, a path without a leaf is null."""
    parts = F.transform(F.split(path, ">"), trimmed)
    leaf = F.element_at(parts, -1)
    return F.when(leaf != "", F.concat(F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p != ""), F.array(leaf)))


def hierarchies(items: DataFrame) -> DataFrame:
    """(id, tree) of items(id, position, path, leaf): JSON trees in which every leaf, itself JSON, stands in its category.

    A category of leaves is a list, in their order; one of categories is an object; one of both is an object that has its
    leaves under the empty key. Built from the deepest categories up, a level a step."""
    rows = materialized(items.select("id", "position", "path", "leaf"), "leaves")
    listed = F.array_sort(F.collect_list(F.struct("position", "leaf")))
    lists = materialized(rows.groupBy("id", "path").agg(F.array_join(F.transform(listed, lambda x: x["leaf"]), ",").alias("leaves")), "leaf-lists")
    deepest = lists.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    inner = lists.select("id", "path", F.lit("").alias("inside")).limit(0)
    for depth in range(deepest, -1, -1):
        own = lists.filter(F.size("path") == depth).join(inner, ["id", "path"], "full_outer")
        json = (
            F.when(F.col("inside").isNull(), F.concat(F.lit("["), "leaves", F.lit("]")))
            .when(F.col("leaves").isNull(), F.concat(F.lit("{"), "inside", F.lit("}")))
            .otherwise(F.concat(F.lit('{"":['), "leaves", F.lit("],"), "inside", F.lit("}")))
        )
        built = own.select("id", "path", json.alias("json"))
        if depth == 0:
            return built.select("id", F.col("json").alias("tree"))
        key = F.element_at("path", -1)
        members = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.concat(quoted(key), F.lit(":"), "json").alias("json"))))
        inner = materialized(
            built.groupBy("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_join(F.transform(members, lambda m: m["json"]), ",").alias("inside")), "tree-inner"
        )
    return lists.select("id", F.lit("").alias("tree")).limit(0)


def paths(tree: DataFrame) -> DataFrame:
    """(node, path) of tree(node, parent, name): the names from the root down.

    Every node's path doubles in a step by that of the ancestor where it ends, so deep trees take few steps. A parent that
    isn't in the tree ends the path. Raises for circles."""
    own = tree.select("node", F.col("parent").alias("next"), F.array("name").alias("path"))
    known = tree.select(F.col("node").alias("next"))
    now = materialized(own.join(known, "next", "left_semi").unionByName(own.join(known, "next", "left_anti").withColumn("next", F.lit(None).cast(tree.schema["node"].dataType))), "paths")
    while True:
        n, longest, open_ = now.agg(F.count("*"), F.max(F.size("path")), F.count("next")).first()
        if not open_:
            return now.select("node", "path")
        if longest > n:
            raise ValueError("the tree has a circle")
        n, a = now.alias("n"), now.alias("a")
        now = materialized(n.join(a, F.col("n.next") == F.col("a.node"), "left").select("n.node", F.col("a.next").alias("next"), F.concat(F.coalesce("a.path", F.array().cast("array<string>")), "n.path").alias("path")), "paths")


def _key(path: Column) -> Column:
    return F.lower(F.array_join(path, "/"))


def category_labels(categories: DataFrame) -> DataFrame:
    """(label, path, position) of categories(position, path): what each leaf category may be called.

    A leaf is called by its own name where no other has it, else by its full path. A name that is an earlier label
    already gives way to the full path; a path that is one already is left out."""
    rows = categories.select("position", F.filter(F.transform("path", trimmed), lambda p: p != "").alias("path")).filter(F.size("path") > 0)
    leaf, full = F.element_at("path", -1), F.array_join("path", "/")
    alone = F.count("*").over(Window.partitionBy(F.lower(leaf))) == 1
    called = rows.withColumn("full", full).withColumn("label", F.when(alone, leaf).otherwise(full))
    before = F.row_number().over(Window.partitionBy(F.lower("label")).orderBy("position"))
    second = called.withColumn("n", before).withColumn("label", F.when(F.col("n") == 1, F.col("label")).otherwise(F.col("full")))
    again = F.row_number().over(Window.partitionBy(F.lower("label")).orderBy("n", "position"))
    return second.withColumn("n", again).filter("n = 1").select("label", "path", "position")


def resolved(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """`asked` with a column `path`: the category that asked.label names among labels(label, path, position), or null.

    Labels and full paths name a category, in whatever case; a label comes before a path. Blanks and slashes around
    them don't count, and `>` or a backslash may part a path as well."""
    keys = labels.select(F.lower("label").alias("key"), F.lit(0).alias("rank"), "position", "path").unionByName(labels.select(_key(F.col("path")).alias("key"), F.lit(1).alias("rank"), "position", "path"))
    index = keys.groupBy("key").agg(F.min_by("path", F.struct("rank", "position")).alias("path"))
    bare = trimmed(F.regexp_replace(trimmed(F.col("label")), "^/+|/+$", ""))
    parted = F.array_join(F.filter(F.transform(F.split(F.translate(bare, ">\\", "//"), "/"), trimmed), lambda p: p != ""), "/")
    rows = asked.withColumns({"__bare": F.lower(bare), "__parted": F.lower(parted)})
    one, two = index.select(F.col("key").alias("__k1"), F.col("path").alias("__p1")), index.select(F.col("key").alias("__k2"), F.col("path").alias("__p2"))
    held = rows.join(one, F.col("__bare") == F.col("__k1"), "left").join(two, F.col("__parted") == F.col("__k2"), "left")
    return held.withColumn("path", F.when(F.col("__bare") != "", F.coalesce("__p1", "__p2"))).drop("__bare", "__parted", "__k1", "__p1", "__k2", "__p2")


def expanded(item: Column, bilingual: bool, aliases: bool) -> Column:
    """A keyword that is given by places as JSON with names; null where it can't be read.

    A list is the keyword and more terms for it (`aliases`) or its translation; with both, a list for each language.
    Texts and objects stay as they are, and so does all where neither was asked for."""
    whole = F.to_json(item)
    if not bilingual and not aliases:
        return whole
    slots = F.try_variant_get(item, "$", "array<variant>")
    text = lambda v: F.to_json(v)
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, text), ","), F.lit("]"))
    member = lambda f, c: F.when(F.size(c) > 0, F.concat(F.lit(f'"{f}":'), listed(c)))
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    parts = lambda *fields: F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    name = lambda c: F.concat(F.lit('"name":'), text(F.element_at(c, 1)))
    flat = parts(member("aliases", rest(slots)), name(slots)) if not bilingual else parts(name(slots), member("synonyms", rest(slots)))
    out = F.when(F.size(slots) > 0, flat)
    if bilingual and aliases:
        group = lambda i: F.coalesce(F.try_variant_get(item, f"$[{i}]", "array<variant>"), F.array().cast("array<variant>"))
        one, two = group(0), group(1)
        groups = parts(member("aliases", rest(one)), name(one), member("synonym_aliases", rest(two)), member("synonyms", F.slice(two, 1, 1)))
        out = F.when(F.exists(slots, lambda s: _kind(s) == "array"), F.when(F.size(one) > 0, groups)).otherwise(out)
    return F.when(_kind(item) == "array", out).otherwise(whole)


def regrouped(answers: DataFrame, labels: DataFrame, bilingual: bool = False, aliases: bool = False) -> DataFrame:
    """(id, tree) of answers(id, groups), groups being JSON lists of {category, items}: trees over the categories.

    A category that isn't known keeps its keywords under its own name. What isn't such a list stays as it is; groups
    without a category or items are left out."""
    spark = answers.sparkSession
    parsed = materialized(answers.select("id", F.try_parse_json("groups").alias("v")).filter("v IS NOT NULL"), "answers")
    top = parsed.filter(_kind(F.col("v")) == "array").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", F.col("pos").alias("group"), F.col("value").alias("g"))
    has = lambda f: F.try_variant_get("g", f"$.{f}", "variant").isNotNull()
    groups = materialized(top.filter((_kind(F.col("g")) == "object") & has("category") & has("items")), "groups")
    category, items = F.try_variant_get("g", "$.category", "variant"), F.try_variant_get("g", "$.items", "variant")
    whole = groups.select("id", "group", category.alias("c"), items.alias("items")).filter((_kind(F.col("c")) == "string") & (_kind(F.col("items")) == "array"))
    each = whole.lateralJoin(spark.tvf.variant_explode(F.col("items").outer())).select("id", F.struct("group", "pos").alias("position"), F.try_variant_get("c", "$", "string").alias("label"), expanded(F.col("value"), bilingual, aliases).alias("leaf"))
    each = each.filter("leaf IS NOT NULL AND leaf <> 'null'")
    own = F.array(trimmed(F.col("label")))
    placed = resolved(each, labels).withColumn("path", F.coalesce("path", F.when(trimmed(F.col("label")) != "", own))).filter("path IS NOT NULL")
    grouped = groups.select("id").distinct()
    built = hierarchies(placed)
    empty = grouped.join(built.select("id"), "id", "left_anti").select("id", F.lit("{}").alias("tree"))
    return built.unionByName(empty).unionByName(parsed.join(grouped, "id", "left_anti").select("id", F.to_json("v").alias("tree")))

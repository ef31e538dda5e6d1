"""Registered queries of keyword trees. Parts are photos, whose keywords are JSON of different depth; nations are categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import trees
from lumenlake.plans.search import table

#: The JSON tree of a part, in words that Spark and DuckDB have in common; members stand in the order of their keys.
_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_LIST = f"""'["' || {_W1} || '",{{"aliases":["' || p_brand || '"],"name":"' || {_W2} || '","synonyms":["' || upper({_W2}) || '","' || {_W1} || ' ' || {_W2} || '"]}}]'"""
TREE = f"""CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN {_LIST}
WHEN 1 THEN '{{"' || p_type || '":' || {_LIST} || '}}'
WHEN 2 THEN '{{"' || p_brand || '":"' || {_W1} || '","' || p_type || '":{{"Size":' || {_LIST} || ',"' || {_W1} || '":"' || upper({_W1}) || '"}}}}'
WHEN 3 THEN '{{"' || p_type || '":{{"' || p_brand || '":{{"Size":{{"' || {_W1} || '":' || {_LIST} || '}}}},"Void":{{}},"n":3}}}}'
WHEN 4 THEN '{{"' || p_type || '":{{"name":"' || {_W2} || '","synonyms":["' || {_W1} || '",4]}}}}'
WHEN 5 THEN '"' || p_name || '"' ELSE '{{"a":' END"""


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(TREE).alias("tree"))


def keyword_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword of every tree, in the order of the walk, with its depth in categories."""
    k = trees.keywords(trees.nodes(_trees(spark, sf_dir)))
    return k.selectExpr("id", "cast(row_number() OVER (PARTITION BY id ORDER BY at) AS int) AS n", "name", "kind", "size(path) AS depth", "array_join(path, ' > ') AS path")


def keyword_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flattened(trees.nodes(_trees(spark, sf_dir)))


def keyword_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are merged into others wherever they stand; whole trees come back."""
    merges = spark.createDataFrame([("Widget", "gadget", 1), (" RING ", "small", 2), ("small ring", "small", 3), ("same", "SAME", 4), ("", "x", 5)], "duplicate string, canonical string, position int")
    found = trees.replaced(trees.nodes(_trees(spark, sf_dir)), merges)
    changed = found.groupBy("id").agg(F.max("changed").alias("changed"))
    return trees.assembled(found).join(changed, "id").select("id", "tree", "changed")


def keyword_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.leaves(trees.nodes(_trees(spark, sf_dir)))
    return found.select("id", "keyword_id", "name", "path", *(F.array_join(f, "|").alias(f) for f in trees.LISTS))


def keyword_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees to leaves to paths and back to trees, for lists of keywords at any depth."""
    whole = _trees(spark, sf_dir).filter("id % 7 IN (0, 1, 3)")
    found = trees.leaves(trees.nodes(whole))
    path = F.slice(trees.split_path(F.concat_ws(" > ", F.nullif("path", F.lit("")), "name")), F.lit(1), F.size(F.split("path", ">")) - F.when(F.col("path") == "", 1).otherwise(0))
    leaf = trees.leaf_json(F.col("name"), F.col("synonyms"), F.col("aliases"), F.col("synonym_aliases"))
    position = F.substring("keyword_id", 4, 10).cast("int")
    return trees.hierarchies(found.select("id", position.alias("position"), path.alias("path"), leaf.alias("leaf")))


def keyword_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree in which each hangs below the one of half its number: the names from the root down."""
    tree = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).alias("parent"), F.col("p_name").alias("name"))
    return trees.paths(tree).select("node", F.size("path").alias("depth"), F.array_join("path", ">").alias("path"))


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    leaf = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Group "), (F.col("n_nationkey") % 2).cast("string"))).otherwise(F.col("n_name"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("position"), F.array("r_name", leaf).alias("path"))


def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.category_labels(_categories(spark, sf_dir)).select("position", "label", F.array_join("path", "/").alias("path"))


def category_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' labels name: nations, groups that several regions have, paths written in several ways, and others."""
    c = table(spark, sf_dir, "customer").join(_categories(spark, sf_dir), F.col("c_nationkey") == F.col("position"))
    top, leaf = F.col("path")[0], F.col("path")[1]
    k = F.col("c_custkey") % 6
    label = (
        F.when(k == 0, leaf).when(k == 1, F.concat(F.lit(" /"), F.lower(leaf), F.lit("/ "))).when(k == 2, F.concat(top, F.lit(" > "), leaf)).when(k == 3, F.concat(F.upper(top), F.lit("\\"), leaf, F.lit("\\")))
        .when(k == 4, F.concat(top, F.lit("/"), leaf)).otherwise(F.col("c_mktsegment"))
    )
    found = trees.resolved(c.select("c_custkey", label.alias("label")), trees.category_labels(_categories(spark, sf_dir)))
    return found.select("c_custkey", "label", F.array_join("path", "/").alias("path"))


def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' answers: groups of keywords in two languages, by place, back as trees over the categories."""
    s = table(spark, sf_dir, "supplier").join(_categories(spark, sf_dir), F.col("s_nationkey") == F.col("position"))
    given = s.select(F.col("s_suppkey").alias("id"), F.col("path")[0].alias("top"), F.col("path")[1].alias("leaf"))
    answers = given.select("id", F.expr(_ANSWER).alias("groups"))
    return trees.regrouped(answers, trees.category_labels(_categories(spark, sf_dir)), bilingual=True, aliases=True)


_ANSWER = """CASE WHEN id % 5 = 4 THEN '["plain",' || CAST(id AS VARCHAR(20)) || ']' ELSE
'[{"category":"' || top || ' > ' || leaf || '","items":[[["berg","gipfel"],["mountain","peak"]],["see","lake"],"wald"]},{"category":"Own","items":[[["tal"]]]},{"category":"lost"}]' END"""

_WALK = f"""trees AS (SELECT p_partkey AS id, {TREE} AS tree FROM part),
walk AS (
  SELECT id, []::BIGINT[] AS place, NULL::VARCHAR AS key, 'root' AS role, []::VARCHAR[] AS path, CAST(tree AS JSON) AS v FROM trees WHERE json_valid(tree)
  UNION ALL
  SELECT id, place || [CASE WHEN leaf AND k IN ('name', 'synonyms', 'aliases', 'synonym_aliases') THEN list_position(['name', 'synonyms', 'aliases', 'synonym_aliases'], k) - 1 ELSE 4 + o END],
    CASE WHEN json_type(v) = 'OBJECT' THEN k END,
    CASE WHEN leaf THEN CASE WHEN k IN ('name', 'synonyms', 'aliases', 'synonym_aliases') THEN k ELSE 'other' END
      WHEN json_type(v) = 'OBJECT' AND role IN ('root', 'category') THEN 'category' WHEN json_type(v) = 'ARRAY' AND role IN ('root', 'category') THEN 'keyword'
      WHEN role = 'synonyms' THEN 'synonym' WHEN role = 'aliases' THEN 'alias' WHEN role = 'synonym_aliases' THEN 'synonym_alias' ELSE 'other' END,
    CASE WHEN role = 'category' THEN path || [key] ELSE path END, x
  FROM (
    SELECT t.*, e.key AS k, CAST(e.id AS BIGINT) AS o, e.value AS x, json_type(t.v) = 'OBJECT' AND (role = 'keyword' OR (role = 'category' AND json_exists(t.v, '$.name'))) AS leaf
    FROM walk t, json_each(t.v) e WHERE json_type(t.v) IN ('OBJECT', 'ARRAY')
  )
),
said AS (
  SELECT id, place, path, key AS name, 'category' AS kind FROM walk WHERE role = 'category'
  UNION ALL SELECT id, place || [0], path, v->>'$', 'keyword' FROM walk WHERE role = 'category' AND json_type(v) = 'VARCHAR'
  UNION ALL SELECT id, place, path, v->>'$', CASE WHEN role IN ('keyword', 'name') THEN 'keyword' WHEN role = 'root' THEN 'text' ELSE role END
    FROM walk WHERE role IN ('root', 'keyword', 'name', 'synonym', 'alias', 'synonym_alias') AND json_type(v) = 'VARCHAR'
),
words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(trim(name)) ORDER BY place) AS k FROM said WHERE trim(name) <> '') WHERE k = 1)"""
_CATEGORIES = """cats AS (SELECT n_nationkey AS position, r_name AS top, CASE WHEN n_nationkey % 3 = 0 THEN 'Group ' || n_nationkey % 2 ELSE n_name END AS leaf FROM nation JOIN region ON n_regionkey = r_regionkey),
labels AS (SELECT DISTINCT ON (lower(label)) * FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY leaf) = 1 THEN leaf ELSE top || '/' || leaf END AS label FROM cats) ORDER BY lower(label), position)"""

QUERIES = {f.__name__: f for f in (keyword_tree, keyword_text, keyword_replace, keyword_leaves, keyword_round_trip, keyword_paths, category_labels, category_resolution, keyword_groups)}

SQL = {
    "keyword_tree": f"WITH RECURSIVE {_WALK} SELECT id, row_number() OVER (PARTITION BY id ORDER BY place)::INTEGER AS n, name, kind, len(path)::INTEGER AS depth, array_to_string(path, ' > ') AS path FROM words",
    "keyword_text": f"WITH RECURSIVE {_WALK} SELECT id, string_agg(name, ', ' ORDER BY place) AS text FROM words GROUP BY id",
    "keyword_replace": f"""WITH t AS (SELECT p_partkey AS id, {TREE} AS old FROM part WHERE p_partkey % 7 <> 6),
r AS (SELECT *, replace(replace(replace(replace(replace(old, '"ring"', '"small"'), '"RING"', '"small"'), '"small ring"', '"small"'), '"widget"', '"gadget"'), '"WIDGET"', '"gadget"') AS new FROM t)
SELECT id, replace(new, '["small","small"]', '["small"]') AS tree, new <> old AS changed FROM r""",
    "keyword_leaves": f"""WITH RECURSIVE {_WALK},
own AS (
  SELECT id, place, key, path, v->>'$' AS name, []::VARCHAR[] AS s, []::VARCHAR[] AS a FROM walk WHERE role IN ('keyword', 'category') AND json_type(v) = 'VARCHAR'
  UNION ALL SELECT id, place, key, path, v->>'$.name', list_filter(CAST(v->'$.synonyms' AS JSON[]), lambda x: json_type(x) = 'VARCHAR').list_transform(lambda x: x->>'$'), CAST(v->'$.aliases' AS VARCHAR[])
    FROM walk WHERE role IN ('keyword', 'category') AND json_type(v) = 'OBJECT' AND json_type(v->'$.name') = 'VARCHAR'
),
placed AS (SELECT id, place, name, array_to_string(CASE WHEN key IS NOT NULL AND key <> name THEN path || [key] ELSE path END, ' > ') AS path,
  coalesce(list_filter(s, lambda x: lower(x) <> lower(name)), []) AS s, coalesce(list_filter(a, lambda x: lower(x) <> lower(name)), []) AS a FROM own),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, path, name ORDER BY place) AS k FROM placed) WHERE k = 1)
SELECT id, 'kw_' || row_number() OVER (PARTITION BY id ORDER BY place) AS keyword_id, name, path, array_to_string(s, '|') AS synonyms, array_to_string(a, '|') AS aliases, '' AS synonym_aliases FROM once""",
    # The same trees, less what isn't a keyword and the synonym that only differs in case.
    "keyword_round_trip": f"""SELECT p_partkey AS id, replace(replace(tree, ',"Void":{{}},"n":3', ''), '"synonyms":["' || upper({_W2}) || '",', '"synonyms":[') AS tree
FROM (SELECT *, {TREE} AS tree FROM part) WHERE p_partkey % 7 IN (0, 1, 3)""",
    "keyword_paths": """WITH RECURSIVE t AS (
  SELECT p_partkey AS node, 1 AS depth, p_name AS path FROM part WHERE p_partkey = 0
  UNION ALL SELECT p_partkey, depth + 1, path || '>' || p_name FROM part JOIN t ON p_partkey // 2 = node WHERE p_partkey > 0 AND p_partkey <> node
) SELECT * FROM t""",
    "category_labels": f"WITH {_CATEGORIES} SELECT position, label, top || '/' || leaf AS path FROM labels",
    "category_resolution": f"""WITH {_CATEGORIES},
c AS (
  SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN leaf WHEN 1 THEN ' /' || lower(leaf) || '/ ' WHEN 2 THEN top || ' > ' || leaf WHEN 3 THEN upper(top) || '\\' || leaf || '\\' WHEN 4 THEN top || '/' || leaf ELSE c_mktsegment END AS label
  FROM customer JOIN cats ON c_nationkey = position
),
k AS (SELECT *, array_to_string(list_filter(list_transform(string_split(translate(label, '>\\', '//'), '/'), lambda x: trim(x)), lambda x: x <> ''), '/') AS key FROM c),
names AS (SELECT lower(label) AS key, top || '/' || leaf AS path FROM labels UNION SELECT lower(top || '/' || leaf), top || '/' || leaf FROM labels)
SELECT c_custkey, label, path FROM k LEFT JOIN names ON lower(k.key) = names.key""",
    "keyword_groups": f"""WITH {_CATEGORIES},
s AS (SELECT s_suppkey AS id, top, leaf FROM supplier JOIN cats ON s_nationkey = position)
SELECT id, CASE WHEN id % 5 = 4 THEN '["plain",' || id || ']' ELSE
  '{{"' || top || '":{{"' || leaf || '":[{{"aliases":["gipfel"],"name":"berg","synonym_aliases":["peak"],"synonyms":["mountain"]}},{{"name":"see","synonyms":["lake"]}},"wald"]}},"Own":[{{"name":"tal"}}]}}' END AS tree FROM s""",
}

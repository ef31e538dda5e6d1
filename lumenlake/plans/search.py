"""Registered queries of search and similarity, with SQL. `embeddings` and `documents` stand in for photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.scalar import hamming, hash64, round_even
from lumenlake.functions.vector import cosine_or_null, cosine_or_one
from lumenlake.operators import pairs, search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_of(df: DataFrame, id_: int) -> list[float]:
    """The vector of one photo: a point lookup."""
    return list(df.filter(F.col("id") == id_).select("vector").first()[0])


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = photos(spark, sf_dir)
    return search.nearest(p.filter("id <> 0"), vector_of(p, 0), 10).select("id", F.round("distance", 6).alias("distance"))


def relevance_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = photos(spark, sf_dir)
    return search.relevant(search.nearest(p, vector_of(p, 0), 300, digits=4), 50)


def relevance_cut_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = photos(spark, sf_dir)
    return search.relevant(search.nearest(p.filter("id <> 0"), vector_of(p, 0), 300, digits=4), 75)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    p = photos(spark, sf_dir)
    rows = p.join(docs, "id")
    return search.hybrid(rows, vector_of(p, 0), "license", ["text", "source"], most=60)


def similar_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = photos(spark, sf_dir)
    return search.nearest(p.filter("id <> 3"), vector_of(p, 3), 100).select("id", F.round("distance", 6).alias("distance"))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), hash64(F.substring(F.md5("text"), 1, 16)).alias("hash"))


def hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose hashes differ in fifteen bits or fewer."""
    return pairs.hash_pairs(_hashes(spark, sf_dir), 15)


def similar_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hashes(spark, sf_dir)
    return search.similar_by_hash(h, 0, h.filter("id = 0").first().hash, k=24, most=50)


def similar_hash_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest by hash, then by vector; photos without a vector last."""
    h, p = _hashes(spark, sf_dir), photos(spark, sf_dir)
    found = search.similar_by_hash(h, 0, h.filter("id = 0").first().hash, k=26, most=2000).join(p.select("id", "vector"), "id", "left")
    clip = F.round(cosine_or_one(F.col("vector"), F.lit(vector_of(p, 0))), 6).alias("clip")
    return found.select("id", "hamming", clip).orderBy("hamming", F.asc_nulls_last("clip"), "id").limit(50)


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return search.in_scope(docs, ids, F.col("source") == "src1")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.matching(docs, "LICENSE_%", ["text"]).unionByName(search.matching(docs, "License", ["text", "lang"])).select("doc_id", "lang")


def prompt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids 0 to 4 as good and 5 to 9 as bad prompts."""
    p = photos(spark, sf_dir)
    pairs = p.filter("id < 5").select("id", F.col("vector").alias("good")).join(p.filter("id BETWEEN 5 AND 9").select((F.col("id") - 5).alias("id"), F.col("vector").alias("bad")), "id")
    return search.prompt_scores(p, pairs.select("good", "bad")).select("id", F.round("score", 6).alias("score"))


def cosine_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and grouping distances to photo 1, and to the zero vector."""
    p = photos(spark, sf_dir)
    q = F.lit(vector_of(p, 1))
    zero = F.transform("vector", lambda x: F.lit(0.0))
    v = F.col("vector")
    return p.filter("id <> 1").select(
        "id", F.round(cosine_or_one(v, q), 6).alias("search"), F.round(cosine_or_null(v, q), 6).alias("grouping"), cosine_or_one(v, zero).alias("search_zero"), cosine_or_null(v, zero).alias("grouping_zero")
    )


def hash_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hashes(spark, sf_dir)
    one = h.filter("id = 0").first().hash
    return h.select("id", hamming(F.col("hash"), F.lit(one)).cast("int").alias("bits"), round_even(F.col("id") / 3, 4).alias("third"))


_COS = "1 - list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


def _query(id_: int) -> str:
    return f"(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {id_}) q"


def _relevance(skip: str, strictness: int) -> str:
    k = 0.5 + (strictness - 25) * (1.5 / 75)
    return f"""
WITH top AS (SELECT vec_id AS id, round_even(({_COS})::DOUBLE * 10000, 0)::DOUBLE / 10000 AS distance FROM embeddings e, {_query(0)} {skip} ORDER BY distance, id LIMIT 300),
r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rn, lead(distance) OVER (ORDER BY distance, id) AS nx, count(*) OVER () AS n FROM top),
t AS (SELECT list_sort(list(distance)) AS s FROM r WHERE rn > n // 2),
c AS (SELECT s[len(s) // 2 + 1] - {k} * greatest(s[(3 * len(s)) // 4 + 1] - s[len(s) // 4 + 1], 1e-6) AS usual FROM t),
k AS (SELECT min(distance) AS knee FROM r WHERE rn <= 100 AND (nx - distance) / greatest(distance, 1e-6) >= 0.15),
m AS (SELECT r.*, distance <= coalesce(knee, usual) AS within FROM r, c, k),
w AS (SELECT *, count(*) FILTER (within) OVER () AS kept FROM m)
SELECT id, distance FROM w WHERE n <= 8 OR CASE WHEN kept < 8 THEN rn <= 8 ELSE within END"""


_HASH = "('0x' || substr(md5(text), 1, 16))::UBIGINT"
_BITS = f"bit_count(xor({_HASH}, (SELECT {_HASH} FROM documents WHERE doc_id = 0)))::INTEGER"

QUERIES = {f.__name__: f for f in (knn_topk, relevance_cut, relevance_cut_strict, hybrid_search, similar_clip, hash_join, similar_hash, similar_hash_reranked, scope_filter, text_search, prompt_score, cosine_variants, hash_distances)}

SQL = {
    "hash_join": """
WITH h AS (SELECT doc_id AS id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS h FROM documents)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INTEGER AS bits FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 15""",
    "knn_topk": f"SELECT vec_id AS id, round({_COS}, 6) AS distance FROM embeddings e, {_query(0)} WHERE vec_id <> 0 ORDER BY {_COS}, vec_id LIMIT 10",
    "relevance_cut": _relevance("", 50),
    "relevance_cut_strict": _relevance("WHERE vec_id <> 0", 75),
    "hybrid_search": f"""
WITH sem AS (SELECT * FROM ({_relevance("", 50).replace("FROM embeddings e,", "FROM (SELECT e0.* FROM embeddings e0 JOIN documents ON vec_id = doc_id) e,").replace("LIMIT 300", "LIMIT 60")})),
txt AS (SELECT vec_id AS id, NULL::DOUBLE AS distance, 1 AS part FROM embeddings JOIN documents ON vec_id = doc_id
  WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND vec_id NOT IN (SELECT id FROM sem) ORDER BY id LIMIT 60)
SELECT * FROM (SELECT id, distance, 0 AS part FROM sem UNION ALL SELECT * FROM txt) ORDER BY part, distance, id LIMIT 60""",
    "similar_clip": f"SELECT vec_id AS id, round({_COS}, 6) AS distance FROM embeddings e, {_query(3)} WHERE vec_id <> 3 ORDER BY {_COS}, vec_id LIMIT 100",
    "similar_hash": f"SELECT id, hamming FROM (SELECT doc_id AS id, {_BITS} AS hamming FROM documents WHERE doc_id <> 0) WHERE hamming <= 24 ORDER BY hamming, id LIMIT 50",
    "similar_hash_reranked": f"""
WITH h AS (SELECT id, hamming FROM (SELECT doc_id AS id, {_BITS} AS hamming FROM documents WHERE doc_id <> 0) WHERE hamming <= 26 ORDER BY hamming, id LIMIT 2000),
c AS (SELECT vec_id, round({_COS}, 6) AS clip FROM embeddings e, {_query(0)})
SELECT id, hamming, clip FROM h LEFT JOIN c ON id = vec_id ORDER BY hamming, clip NULLS LAST, id LIMIT 50""",
    "scope_filter": "SELECT doc_id AS id, source, lang FROM documents WHERE source = 'src1' AND doc_id IN (SELECT vec_id FROM embeddings)",
    "text_search": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license_%') UNION ALL SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(lang), 'license')",
    "prompt_score": """
WITH p AS (SELECT g.embedding::DOUBLE[] AS good, b.embedding::DOUBLE[] AS bad FROM embeddings g JOIN embeddings b ON b.vec_id = g.vec_id + 5 WHERE g.vec_id < 5),
n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT id, round(avg(1 / (1 + exp(-100 * (list_cosine_similarity(v, good) - list_cosine_similarity(v, bad))))), 6) AS score FROM n, p GROUP BY id""",
    "cosine_variants": f"""
SELECT vec_id AS id, round({_COS}, 6) AS search, round(1 - greatest(-1, least(1, 1 - ({_COS}))), 6) AS "grouping", 1.0::DOUBLE AS search_zero, NULL::DOUBLE AS grouping_zero
FROM embeddings e, {_query(1)} WHERE vec_id <> 1""",
    "hash_distances": f"SELECT doc_id AS id, {_BITS} AS bits, round_even((doc_id / 3)::DOUBLE * 10000, 0)::DOUBLE / 10000 AS third FROM documents",
}

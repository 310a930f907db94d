"""Queries of ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text, vectors
from skein.operators import search
from skein.plans.stems import stems_of
from skein.session import table


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct chunks with the columns named (point_id, the key, is always there), so that no scan or shuffle has others."""
    return table(spark, d, "chunks").select("point_id", *columns).distinct()


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks with their dense vectors, narrow."""
    return chunks(spark, d, "collection", "rel_path", "language").join(embedded(spark, d), "point_id")


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """Distinct dense vectors."""
    return table(spark, d, "embedded_chunks").select("point_id", "dense_vector").distinct()


def first_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embedded_chunks").where(vectors.usable(F.col("dense_vector"), 64))
    return rows.orderBy("point_id").limit(1).select(F.col("dense_vector").alias("query_vector"))


def of_chunks(spark: SparkSession, d: str, best: DataFrame, *columns: str) -> DataFrame:
    """The few rows of a top-k with columns of their chunks: joined after the search, the k ids sent to the scan."""
    few = table(spark, d, "chunks").select("point_id", *columns).join(F.broadcast(best.select("point_id")), "point_id", "left_semi").distinct()  # k rows
    return few.join(best, "point_id")


def existing(spark: SparkSession, d: str) -> DataFrame:
    """Distinct vectors of points that are chunks; only ids are moved for it."""
    return embedded(spark, d).join(table(spark, d, "chunks").select("point_id"), "point_id", "left_semi")


def dense_topk(spark, d):
    return of_chunks(spark, d, search.dense_topk(existing(spark, d), first_vector(spark, d), 10), "collection").select("point_id", "collection", "score")


def dense_topk_min_score(spark, d):
    return search.dense_topk(existing(spark, d), first_vector(spark, d), 20, min_score=0.3).select("point_id", "score")


def dense_search(spark, d):
    """The ten nearest of every vector whose id is divisible by 100, among all."""
    rows = embedded(spark, d)
    return search.dense_topk_set(rows, rows.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id"), 10)


def dense_topk_filtered(spark, d):
    return search.dense_topk(vectors_of(spark, d), first_vector(spark, d), 10, language="python").select("point_id", "language", "score")


def token_freq(spark, d):
    rows = chunks(spark, d, "content").select(F.explode(text.tokens(F.col("content"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def bm25_weights(spark, d):
    return search.postings(chunks(spark, d, "content"), ["point_id"], "content").withColumn("weight", F.round("weight", 6))


def sparse_topk(spark, d):
    return search.sparse_topk(chunks(spark, d, "content"), table(spark, d, "search_queries"), 10)


def hybrid_rrf(spark, d):
    return search.hybrid_rrf(table(spark, d, "search_hits"))


def maxsim_rerank(spark, d):
    return search.rerank(table(spark, d, "search_hits")).withColumn("late", F.round("late", 6))


def adaptive_rerank(spark, d):
    return search.adaptive_rerank(table(spark, d, "search_hits"))


def rerank_counters(spark, d):
    return search.rerank_counters(search.adaptive_rerank(table(spark, d, "search_hits")))


def cross_collection_rrf(spark, d):
    return search.cross_collection_rrf(table(spark, d, "search_hits"))


def fan_out_search(spark, d):
    return search.fan_out(table(spark, d, "search_hits"))


def multihop_rrf(spark, d):
    best = search.best_hits(table(spark, d, "search_hits")).where(F.col("scorer").isin("dense", "sparse"))
    hops = search.top_per(best.withColumn("hop", F.when(F.col("scorer") == "dense", 1).otherwise(2)), ["query_id", "hop"], [F.desc("score"), F.col("chunk_id")], 20)
    return search.multi_hop(hops)


def per_collection_topk(spark, d):
    best = search.best_hits(table(spark, d, "search_hits")).where(F.col("scorer") == "sparse")
    return search.top_per(best, ["query_id", "collection"], [F.desc("score"), F.col("chunk_id")], 3).select("query_id", "collection", "chunk_id", "score", "rank")


def maxsim(spark, d):
    """Late interaction of the first vector's eight slices with every chunk's."""
    rows = existing(spark, d).where(vectors.usable(F.col("dense_vector"), 64)).crossJoin(F.broadcast(first_vector(spark, d)))  # one row
    score = vectors.max_similarity(vectors.slices(F.col("query_vector"), 8), vectors.slices(F.col("dense_vector"), 8))
    return rows.select("point_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "point_id").limit(20)


def centroid_by_collection(spark, d):
    rows = vectors_of(spark, d).where(vectors.usable(F.col("dense_vector"), 64))
    c = vectors.centroids(rows, ["collection"], "dense_vector", 64)
    return c.select("collection", "members", F.posexplode("centroid").alias("position", "mean")).withColumn("mean", F.round("mean", 6))


def unit_vectors(spark, d):
    rows = existing(spark, d).where(vectors.usable(F.col("dense_vector"), 64))
    return rows.select("point_id", F.round(vectors.norm(F.col("dense_vector")), 6).alias("norm"), F.posexplode(F.transform(vectors.normalized(F.col("dense_vector")), lambda x: F.round(x, 6))).alias("position", "value"))


def recommend_topk(spark, d):
    return search.recommend(existing(spark, d), [1, 2, 3], [4, 5], 5).select("point_id", "score")


def recommend_glob(spark, d):
    return search.recommend(vectors_of(spark, d), [1, 2], [], 5, path_glob="*/TEST_*.py").select("point_id", "rel_path", "score")


def outlier_chunks(spark, d):
    return search.outliers(existing(spark, d), [1, 2, 3, 4, 5, 6, 7, 8], 5).select("point_id", "nearest", "score")


def context_sample(spark, d):
    return search.context_sample(chunks(spark, d, "chunk_id", "rel_path"), [3, 1, 2], "src/*")


USABLE = "len(dense_vector) = 64 AND list_bool_and(list_transform(dense_vector, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(dense_vector, lambda x: x <> 0))"
VECTORS = f"""
WITH c AS (SELECT DISTINCT point_id, collection, rel_path, language FROM chunks),
e AS (SELECT DISTINCT point_id, dense_vector FROM embedded_chunks WHERE {USABLE}),
v AS (SELECT c.*, e.dense_vector::DOUBLE[] AS dense_vector FROM c JOIN e USING (point_id)),
q AS (SELECT dense_vector::DOUBLE[] AS query_vector FROM embedded_chunks WHERE {USABLE} ORDER BY point_id LIMIT 1)
"""
SCORE = "round(list_cosine_similarity(dense_vector, query_vector), 6)"
BEST = """
WITH best AS (SELECT query_id, scorer, collection, point_id, chunk_id, max(score) AS score FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
"""
HYBRID = BEST + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection, scorer ORDER BY score DESC, chunk_id) AS r FROM best WHERE scorer IN ('dense', 'sparse')),
sums AS (SELECT query_id, collection, point_id, chunk_id, round(sum(1.0::DOUBLE / (2 + r)), 9) AS fused FROM ranked WHERE r <= 25 GROUP BY ALL),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY fused DESC, chunk_id) AS position FROM sums) WHERE position <= 5)
"""
RERANK = """,
near AS (SELECT DISTINCT query_id, collection, point_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection, scorer ORDER BY score DESC, chunk_id) AS n FROM best WHERE scorer IN ('dense', 'sparse')) WHERE n <= 100),
late AS (SELECT query_id, collection, point_id, score AS late FROM best WHERE scorer = 'multivector'),
again AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY late DESC NULLS LAST, chunk_id) AS position FROM near LEFT JOIN late USING (query_id, collection, point_id)) WHERE position <= 5)
"""
ADAPTIVE = HYBRID + RERANK + """,
lead AS (SELECT query_id, collection, count(*) >= 2 AND coalesce(round(max(fused) FILTER (position = 1) - max(fused) FILTER (position = 2), 9) >= 0.02, false) AS skipped FROM hybrid GROUP BY ALL),
adaptive AS (
  SELECT h.query_id, h.collection, point_id, chunk_id, position, skipped FROM hybrid h JOIN lead l USING (query_id, collection) WHERE skipped
  UNION ALL SELECT a.query_id, a.collection, point_id, chunk_id, position, skipped FROM again a JOIN lead l USING (query_id, collection) WHERE NOT skipped)
"""
CROSS = BEST + """,
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_id) AS r FROM best WHERE scorer = 'dense') WHERE r <= {k}),
sums AS (SELECT query_id, collection, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fused FROM ranked GROUP BY ALL),
crossed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, collection DESC, chunk_id DESC) AS position FROM sums) WHERE position <= {k})
"""
TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{Nd}_$]+')"
POSTINGS = r"""
WITH dt AS (SELECT point_id, list_filter(regexp_extract_all(lower(content), '[\p{L}\p{Nd}_$]+'), lambda t: length(t) <= 40) AS ts FROM (SELECT DISTINCT point_id, content FROM chunks)),
dw AS (SELECT point_id, len(ts) AS len, unnest(ts) AS word FROM dt),
qt AS (SELECT query_id, list_filter(regexp_extract_all(lower(query_text), '[\p{L}\p{Nd}_$]+'), lambda t: length(t) <= 40) AS ts FROM search_queries),
qw AS (SELECT query_id, len(ts) AS len, unnest(ts) AS word FROM qt),
ws AS (SELECT word FROM dw UNION SELECT word FROM qw),
""" + stems_of("ws") + """,
dx AS (SELECT point_id, len, stem AS token FROM dw JOIN stems USING (word)),
dp AS (SELECT point_id, token, count(*) * 2.2 / (count(*) + 1.2 * (0.25 + 0.75 * first(len) / 256.0)) AS weight FROM dx GROUP BY point_id, token)
"""
TRIPLE = "list_transform(range(8), lambda i: list_slice({v}, i * 8 + 1, i * 8 + 8))"

QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_search, dense_topk_min_score, dense_topk_filtered, token_freq, bm25_weights, sparse_topk, hybrid_rrf, maxsim_rerank, adaptive_rerank, rerank_counters, cross_collection_rrf,
        fan_out_search, multihop_rrf, per_collection_topk, maxsim, centroid_by_collection, unit_vectors, recommend_topk, recommend_glob, outlier_chunks, context_sample,
    )
}
MEAN = "(SELECT list(m ORDER BY i) FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(dense_vector) AS x, unnest(range(1, 65)) AS i FROM v WHERE point_id IN ({ids})) GROUP BY i))"
SQL = {
    "dense_topk": VECTORS + f"SELECT point_id, collection, {SCORE} AS score FROM v, q ORDER BY score DESC, point_id LIMIT 10",
    "dense_topk_min_score": VECTORS + f"SELECT point_id, {SCORE} AS score FROM v, q WHERE {SCORE} >= 0.3 ORDER BY score DESC, point_id LIMIT 20",
    "dense_topk_filtered": VECTORS + f"SELECT point_id, language, {SCORE} AS score FROM v, q WHERE language = 'python' ORDER BY score DESC, point_id LIMIT 10",
    "token_freq": f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM (SELECT DISTINCT * FROM chunks)) GROUP BY token",
    "bm25_weights": POSTINGS + "SELECT point_id, token, round(weight, 6) AS weight FROM dp",
    "sparse_topk": POSTINGS + r""",
qx AS (SELECT query_id, len, stem AS token FROM qw JOIN stems USING (word)),
qp AS (SELECT query_id, token, count(*) * 2.2 / (count(*) + 1.2 * (0.25 + 0.75 * first(len) / 256.0)) AS query_weight FROM qx GROUP BY query_id, token),
s AS (SELECT query_id, point_id, round(sum(weight * query_weight), 6) AS score FROM dp JOIN qp USING (token) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 10""",
    "hybrid_rrf": HYBRID + "SELECT * FROM hybrid",
    "maxsim_rerank": BEST + RERANK + "SELECT * REPLACE (round(late, 6) AS late) FROM again",
    "adaptive_rerank": ADAPTIVE + "SELECT * FROM adaptive",
    "rerank_counters": ADAPTIVE + "SELECT count(*) AS total, count_if(skipped)::BIGINT AS skipped, count_if(NOT skipped)::BIGINT AS reranked FROM (SELECT DISTINCT query_id, collection, skipped FROM adaptive)",
    "cross_collection_rrf": CROSS.format(k=10) + "SELECT c.*, r.point_id, r.score FROM crossed c JOIN ranked r USING (query_id, collection, chunk_id)",
    "fan_out_search": CROSS.format(k=5) + """, n AS (SELECT query_id, count(DISTINCT collection) AS n FROM best WHERE scorer = 'dense' GROUP BY 1)
SELECT c.query_id, c.collection, c.chunk_id, r.score, c.position FROM crossed c JOIN ranked r USING (query_id, collection, chunk_id) JOIN n USING (query_id) WHERE n > 1
UNION ALL SELECT r.query_id, collection, chunk_id, score, r FROM ranked r JOIN n USING (query_id) WHERE n = 1""",
    "multihop_rrf": BEST + """,
h AS (SELECT *, CASE scorer WHEN 'dense' THEN 1 ELSE 2 END AS hop, row_number() OVER (PARTITION BY query_id, scorer ORDER BY score DESC, chunk_id) AS r FROM best WHERE scorer IN ('dense', 'sparse')),
s AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fused, min(hop) AS hop FROM h WHERE r <= 20 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id DESC) AS position FROM s) WHERE position <= 10""",
    "per_collection_topk": BEST + "SELECT query_id, collection, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_id) AS rank FROM best WHERE scorer = 'sparse') WHERE rank <= 3",
    "maxsim": VECTORS + f", s AS (SELECT point_id, {TRIPLE.format(v='dense_vector')} AS ds, {TRIPLE.format(v='query_vector')} AS qs FROM v, q) SELECT point_id, round(list_sum(list_transform(qs, lambda a: list_max(list_transform(ds, lambda b: list_inner_product(a, b))))), 6) AS score FROM s ORDER BY score DESC, point_id LIMIT 20",
    "centroid_by_collection": VECTORS + ", x AS (SELECT collection, unnest(dense_vector) AS x, unnest(range(64)) AS position FROM v) SELECT collection, position::INT AS position, count(*) AS members, round(avg(x), 6) AS mean FROM x GROUP BY ALL",
    "unit_vectors": VECTORS + ", x AS (SELECT point_id, sqrt(list_inner_product(dense_vector, dense_vector)) AS n, unnest(dense_vector) AS x, unnest(range(64)) AS p FROM v) SELECT point_id, round(n, 6) AS norm, p::INT AS position, round(x / n, 6) AS value FROM x",
    "dense_search": f"""WITH e AS (SELECT DISTINCT point_id, dense_vector::DOUBLE[] AS v FROM embedded_chunks WHERE {USABLE}),
s AS (SELECT q.point_id AS query_id, e.point_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e q WHERE q.point_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 10""",
    "recommend_topk": VECTORS + f", m AS (SELECT {MEAN.format(ids='1, 2, 3')} AS p, {MEAN.format(ids='4, 5')} AS n), w AS (SELECT list_transform(list_zip(p, n), lambda z: 2 * z[1] - z[2]) AS query_vector FROM m) SELECT point_id, {SCORE} AS score FROM v, w WHERE point_id NOT IN (1, 2, 3, 4, 5) ORDER BY score DESC, point_id LIMIT 5",
    "recommend_glob": VECTORS + f", w AS (SELECT {MEAN.format(ids='1, 2')} AS query_vector) SELECT point_id, rel_path, {SCORE} AS score FROM v, w WHERE point_id NOT IN (1, 2) AND rel_path ILIKE '%/TEST\\_%.py' ESCAPE '\\' ORDER BY score DESC, point_id LIMIT 5",
    "outlier_chunks": VECTORS + f""", x AS (SELECT dense_vector AS cv FROM v WHERE point_id BETWEEN 1 AND 8), w AS (SELECT {MEAN.format(ids='1, 2, 3, 4, 5, 6, 7, 8')} AS query_vector),
f AS (SELECT point_id, dense_vector, max(round(list_cosine_similarity(dense_vector, cv), 6)) AS nearest FROM v, x WHERE point_id NOT BETWEEN 1 AND 8 GROUP BY ALL ORDER BY nearest, point_id LIMIT 10)
SELECT point_id, nearest, {SCORE} AS score FROM f, w WHERE {SCORE} <= 0.55 ORDER BY score, point_id LIMIT 5""",
    "context_sample": "SELECT point_id, priority FROM (SELECT DISTINCT point_id, chunk_id, CASE WHEN point_id IN (1, 2, 3) THEN 0 ELSE 1 END AS priority FROM chunks WHERE point_id IN (1, 2, 3) OR rel_path ILIKE 'src/%') ORDER BY priority, chunk_id, point_id LIMIT 200",
}

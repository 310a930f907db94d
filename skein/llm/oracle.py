"""SQL for the corpus queries whose results SQL can state."""

P2_RANKS = """
WITH scored AS (
  SELECT query_id, collection, scorer, point_id, max(score) AS score FROM search_hits
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_id, collection, scorer ORDER BY score DESC) AS r FROM scored),
lists AS (SELECT query_id, collection, scorer, count(*) AS size FROM scored GROUP BY ALL),
points AS (SELECT DISTINCT query_id, collection, point_id FROM scored),
filled AS (
  SELECT p.query_id, p.collection, p.point_id, coalesce(r.r, l.size + 1) AS r, r.r IS NOT NULL AS held
  FROM points p JOIN lists l USING (query_id, collection)
  LEFT JOIN ranked r USING (query_id, collection, scorer, point_id)),
medians AS (
  SELECT query_id, collection, point_id, median(r)::DOUBLE AS median_rank, sum(r)::DOUBLE / count(*) AS mean_rank, max(r) AS worst_rank,
    count(*)::INT AS lists, count_if(held)::INT AS held
  FROM filled GROUP BY ALL)
"""

#: Brute force over all pairs; the posting lists find all of it where there are few of them, as in the smaller tables.
P4 = """
WITH u AS (
  SELECT DISTINCT point_id, dense_vector::DOUBLE[] AS v FROM embedded_chunks
  WHERE len(dense_vector) = 64 AND list_bool_and(list_transform(dense_vector, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(dense_vector, lambda x: x <> 0))),
s AS (SELECT a.point_id, b.point_id AS neighbor, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.point_id <> b.point_id),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY similarity DESC, neighbor) AS rank FROM s) WHERE rank <= 5)
"""

SQL: dict[str, str] = {
    "p1_found": r"""
WITH texts AS (SELECT point_id, max(content) AS content FROM chunks WHERE length(content) > 0 GROUP BY 1),
terms AS (SELECT point_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{Nd}_$]+')) AS term FROM texts),
counts AS (SELECT point_id, term, count(*) AS n FROM terms GROUP BY ALL),
held AS (SELECT *, count(*) OVER (PARTITION BY term) AS records FROM counts)
SELECT point_id, term FROM held WHERE n >= 3 AND records BETWEEN 2 AND 6""",
    "p1_top": r"""
WITH RECURSIVE texts AS (SELECT point_id, max(content) AS content FROM chunks WHERE length(content) > 0 GROUP BY 1),
terms AS (SELECT point_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{Nd}_$]+')) AS term FROM texts),
counts AS (SELECT point_id, term, count(*)::DOUBLE AS n FROM terms GROUP BY ALL),
held AS (SELECT point_id, term, n, sum(n) OVER (PARTITION BY term) / sum(n) OVER () AS background, n / sum(n) OVER (PARTITION BY point_id) AS p FROM counts),
em AS (
  SELECT *, 0 AS round, true AS moved FROM held
  UNION ALL
  SELECT point_id, term, n, background, fresh, round + 1, max(abs(fresh - p)) OVER (PARTITION BY point_id) > 1e-6 FROM (
    SELECT *, e / sum(e) OVER (PARTITION BY point_id) AS fresh FROM (SELECT *, n * 0.1::DOUBLE * p / (0.1::DOUBLE * p + 0.9::DOUBLE * background) AS e FROM em WHERE moved AND round < 200))),
last AS (SELECT point_id, term, round(p, 6) AS score FROM em WHERE NOT moved OR round = 200)
SELECT point_id, term, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY score DESC, term) AS rank FROM last) WHERE rank <= 5""",
    "p2_found": P2_RANKS + "SELECT DISTINCT query_id, point_id FROM medians WHERE worst_rank <= 3 AND lists >= 2 AND held = lists",
    "p2_ranking": P2_RANKS + "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, point_id, collection) AS position FROM medians",
    "p9_limits": """
WITH d AS (SELECT replace(lower(trim(source, ' ')), '-', '_') AS source, count(DISTINCT doc_id) AS documents FROM documents WHERE length(text) > 0 GROUP BY 1),
t AS (SELECT replace(lower(trim(source, ' ')), '-', '_') AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1)
SELECT source, target_share, max_repeats, coalesce(documents, 0) AS documents, true AS keeps_limit, true AS once FROM t LEFT JOIN d USING (source)""",
    "p4_nearest": P4 + "SELECT point_id, neighbor, similarity, rank::INT AS rank FROM nearest",
    "p4_found": P4 + "SELECT DISTINCT least(point_id, neighbor) AS point_a, greatest(point_id, neighbor) AS point_b FROM nearest WHERE similarity >= 0.85",
    "p6_joined": "SELECT point_id, md5(content) AS digest, true AS fits FROM (SELECT DISTINCT point_id, content FROM chunks WHERE length(content) > 2400)",
    "p6_found": "SELECT DISTINCT point_id FROM chunks WHERE length(content) > 2400",
}

"""Queries of stored state, graphs and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import evaluation, graph, incremental, relations, search, state
from skein.plans.search import chunks
from skein.session import cut, table


def scanned_files(spark, d):
    """The newest scan of every file: collection, path, hash, mtime."""
    rows = table(spark, d, "file_records").where(F.col("sha256_hash").isNotNull())
    rows = rows.select("collection", incremental.clean_path(F.col("rel_path")).alias("path"), F.struct("scanned_at", "record_id", F.lower("sha256_hash").alias("hash"), "mtime").alias("s"))
    return rows.groupBy("collection", "path").agg(F.max("s").alias("s")).select("collection", "path", "s.hash", "s.mtime")


def stored_files(spark, d):
    """What the last completed run stored of every file: collection, path, hash, mtime."""
    done = table(spark, d, "index_runs").where((F.col("status") == "completed") & F.col("finished_at").isNotNull()).groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
    rows = table(spark, d, "file_metadata").join(done, "run_id").where(F.col("sha256").isNotNull())
    rows = rows.select("collection", incremental.clean_path(F.col("rel_path")).alias("path"), F.struct("finished_at", "run_id", "recorded_at", F.lower("sha256").alias("hash"), "mtime").alias("s"))
    return rows.groupBy("collection", "path").agg(F.max("s").alias("s")).select("collection", "path", "s.hash", "s.mtime")


def delta_classify(spark, d):
    return state.classify_changes(scanned_files(spark, d), stored_files(spark, d))


def stale_paths(spark, d):
    return state.stale_paths(stored_files(spark, d), scanned_files(spark, d))


def file_metadata_scan(spark, d):
    return state.first_metadata(chunks(spark, d, "chunk_id", "collection", "rel_path", "file_sha256"))


def upsert_result(spark, d):
    """Python and Go chunks stored, Python and Java ones coming in anew with their symbols in lower case."""
    c = chunks(spark, d, "collection", "language", "symbol_name")
    old, new = c.where(F.col("language").isin("python", "go")), c.where(F.col("language").isin("python", "java")).withColumn("symbol_name", F.lower("symbol_name"))
    return state.upsert(old, new, ["point_id"])


def delete_result(spark, d):
    paths = stale_paths(spark, d).select("collection", F.col("path").alias("rel_path"))
    return state.delete_paths(chunks(spark, d, "collection", "rel_path"), paths)


def collection_flags(spark, d):
    runs = table(spark, d, "index_runs").select("collection", "status").distinct()
    all_of = runs.select("collection").distinct().select("collection", F.lit(False).alias("graph_call_sites"), F.lit(False).alias("graph_enabled"))
    flags = runs.select("collection", F.when(F.col("status") == "failed", "graph_call_sites").otherwise("graph_enabled").alias("flag"), (F.col("status") != "running").alias("value"))
    return state.with_flags(all_of, flags)


def _graph(spark, d):
    from skein.plans.relations import calling, defining, newest_files

    c = defining(spark, d, "chunk_id")
    imports = relations.call_imports(chunks(spark, d, "collection", "rel_path", "language", "start_line", "content"), newest_files(spark, d))
    resolved = relations.resolve_calls(relations.calls(calling(spark, d)), relations.definitions(c), imports)
    return c, resolved, graph.edges(c, resolved)


def graph_nodes(spark, d):
    c, resolved, _ = _graph(spark, d)
    return graph.nodes(c, resolved)


def graph_edges(spark, d):
    return _graph(spark, d)[2]


def neighbor_keys(spark, d):
    return graph.neighbor_keys(_graph(spark, d)[2])


def graph_khop(spark, d):
    c, _, e = _graph(spark, d)
    return graph.expand(e, c.orderBy("point_id").limit(3).select(F.col("chunk_id").alias("key")), 2, types=("IN_FILE", "DEFINES", "CALLS"))


def service_graph(spark, d):
    """Imports, endpoints, calls, configurations and build dependencies as edges."""
    from skein.operators import chunking, dependencies
    from skein.plans.relations import newest_files

    files, c = newest_files(spark, d), chunks(spark, d, "chunk_id", "collection", "rel_path", "content")
    deps = dependencies.dependencies(files.select("collection", "path", "content"))
    return graph.service_edges(c, chunking.file_imports(files), deps, c.select("collection").distinct())


def _whole_graph(spark, d):
    return _graph(spark, d)[2].union(service_graph(spark, d))


def neighbor_keys_all(spark, d):
    """neighbor_keys over all families of edges."""
    return graph.neighbor_keys(cut(_whole_graph(spark, d)))


def graph_khop_all(spark, d):
    """Two steps over all families of edges from every chunk whose id is divisible by 100."""
    seeds = chunks(spark, d, "chunk_id").where("point_id % 100 = 0").select(F.col("chunk_id").alias("key"))
    return graph.expand(_whole_graph(spark, d), seeds, 2)


def node_keys(spark, d):
    """Chunks as nodes: their key and how many properties are kept."""
    rows = chunks(spark, d, "chunk_id", "collection", "rel_path", "start_line", "end_line", "language", "symbol_name").withColumn("name", F.col("symbol_name"))
    return graph.node_properties(rows).select("key", F.size("properties").alias("properties"), F.element_at("properties", "name").alias("name"))


def unknown_hits(spark, d):
    """Points that were returned by a search and are no chunks."""
    return search.missing_ids(table(spark, d, "chunks").select("point_id"), table(spark, d, "search_hits"))


def paths_of_stale_chunks(spark, d):
    """Chunks of files that the newest scan has with another content."""
    changed = delta_classify(spark, d).where("change = 'modified'").select("collection", F.col("path").alias("rel_path"))
    return search.chunks_of_paths(chunks(spark, d, "collection", "rel_path", "start_line", "chunk_id"), changed, None).select("collection", "rel_path", "start_line", "chunk_id")


def graph_callers(spark, d):
    _, _, e = _graph(spark, d)
    c = chunks(spark, d, "chunk_id", "collection", "rel_path", "start_line", "symbol_type")
    tokens = table(spark, d, "search_queries").select(F.col("query_text").alias("token")).distinct()
    return graph.callers(e, c, tokens)


def _run(spark, d, scorer):
    best = search.best_hits(table(spark, d, "search_hits")).where(F.col("scorer") == scorer).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return search.top_per(best, ["query_id"], [F.desc("score"), F.col("chunk_id")], 20).select("query_id", "chunk_id", "rank")


def _qrels(spark, d):
    """The multivector scorer's first three as labels of grade 3 to 1."""
    return _run(spark, d, "multivector").where("rank <= 3").select("query_id", "chunk_id", (4 - F.col("rank")).alias("grade"))


def retrieval_metrics(spark, d):
    return evaluation.query_metrics(_run(spark, d, "dense"), _qrels(spark, d))


def mean_metrics(spark, d):
    return evaluation.mean_metrics(retrieval_metrics(spark, d))


def metrics_by_tag(spark, d):
    return evaluation.mean_metrics(evaluation.tagged(retrieval_metrics(spark, d), table(spark, d, "search_queries").distinct()), ["tag"])


def query_stats(spark, d):
    return evaluation.query_stats(_run(spark, d, "dense"), _qrels(spark, d))


def baseline_compare(spark, d):
    """Sparse means against dense ones."""

    def long(scorer):
        m = evaluation.mean_metrics(evaluation.query_metrics(_run(spark, d, scorer), _qrels(spark, d)))
        return m.select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in ("recall", "mrr", "ndcg")])).alias("s")).select("s.*")

    return evaluation.compare(long("sparse"), long("dense"))


def _anchors(spark, d):
    """Every hit as a label: its path, symbol and a line that is off by one for every other language."""
    hits = table(spark, d, "search_hits").groupBy("point_id").agg(F.min("collection").alias("collection"), F.min("rel_path").alias("rel_path"), F.min("symbol_name").alias("symbol"), F.min("start_line").alias("line"), F.min("language").alias("language"))
    return hits.select(F.col("point_id").alias("anchor_id"), "collection", "rel_path", "symbol", (F.col("line") + F.when(F.col("language").isin("python", "go", "java"), 0).otherwise(1)).alias("line"))


def resolved_anchors(spark, d):
    return evaluation.resolve_anchors(_anchors(spark, d), chunks(spark, d, "chunk_id", "collection", "rel_path", "symbol_name", "start_line"))


def drift_report(spark, d):
    return resolved_anchors(spark, d).groupBy("method").agg(F.count("*").alias("anchors"))


def hard_negatives(spark, d):
    return evaluation.hard_negatives(_run(spark, d, "dense"), _qrels(spark, d), table(spark, d, "chunks").select("chunk_id", "content").distinct())


def best_positive(spark, d):
    return evaluation.best_positive(_qrels(spark, d), table(spark, d, "chunks").select("chunk_id", "content").distinct())


def holdout_split(spark, d):
    return evaluation.holdout(table(spark, d, "search_queries").select("query_id", "tags").distinct())


def latency_percentiles(spark, d):
    return evaluation.percentiles(table(spark, d, "events"), "event_type", "value")


QUERIES = {
    f.__name__: f
    for f in (
        delta_classify, stale_paths, file_metadata_scan, upsert_result, delete_result, collection_flags, graph_nodes, graph_edges, neighbor_keys, graph_khop, graph_callers, service_graph, neighbor_keys_all, graph_khop_all, node_keys, unknown_hits, paths_of_stale_chunks, retrieval_metrics, mean_metrics,
        metrics_by_tag, query_stats, baseline_compare, resolved_anchors, drift_report, hard_negatives, best_positive, holdout_split, latency_percentiles,
    )
}

from skein.plans.relations import CALLS, CLEAN  # noqa: E402

STATE = rf"""
WITH scan AS (SELECT collection, path, hash, mtime FROM (SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY scanned_at DESC NULLS LAST, record_id DESC, hash DESC, mtime DESC NULLS LAST) AS n FROM (SELECT collection, {CLEAN} AS path, lower(sha256_hash) AS hash, mtime, scanned_at, record_id FROM file_records WHERE sha256_hash IS NOT NULL)) WHERE n = 1),
done AS (SELECT run_id, max(finished_at) AS finished_at FROM index_runs WHERE status = 'completed' AND finished_at IS NOT NULL GROUP BY 1),
kept AS (SELECT collection, path, hash, mtime FROM (SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY finished_at DESC, run_id DESC, recorded_at DESC NULLS LAST, hash DESC, mtime DESC NULLS LAST) AS n FROM (SELECT m.collection, {CLEAN} AS path, lower(m.sha256) AS hash, m.mtime, d.finished_at, m.run_id, m.recorded_at FROM file_metadata m JOIN done d USING (run_id) WHERE m.sha256 IS NOT NULL)) WHERE n = 1),
stale AS (SELECT collection, path FROM kept ANTI JOIN scan USING (collection, path))
"""
GRAPH = CALLS + """, s AS (SELECT collection, symbol_name, min(collection || ':' || rel_path || '::' || symbol_name) AS target FROM defs GROUP BY 1, 2 HAVING count(*) = 1),
resolved AS (SELECT k.point_id, k.collection, k.token, coalesce(e.target, m.target, k.collection || '::callee::' || k.token) AS target FROM calls k LEFT JOIN s e ON e.collection = k.collection AND e.symbol_name = k.token
LEFT JOIN s m ON m.collection = k.collection AND contains(k.token, '.') AND m.symbol_name = list_last(string_split(k.token, '.'))),
edges AS (
  SELECT DISTINCT 'IN_COLLECTION' AS type, collection || ':' || rel_path AS src, collection AS dst, '' AS token FROM c
  UNION SELECT 'IN_FILE', chunk_id, collection || ':' || rel_path, '' FROM c
  UNION SELECT 'DEFINES', chunk_id, collection || ':' || rel_path || '::' || symbol_name, '' FROM c WHERE length(symbol_name) > 0
  UNION SELECT 'CALLS', chunk_id, target, token FROM resolved JOIN (SELECT DISTINCT point_id, chunk_id FROM c) USING (point_id))
"""
RUN = """
WITH best AS (SELECT query_id, scorer, chunk_id, max(score) AS score FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
runs AS (SELECT scorer, query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY scorer, query_id ORDER BY score DESC, chunk_id) AS rank FROM best) WHERE rank <= 20),
qrels AS (SELECT query_id, chunk_id, 4 - rank AS grade FROM runs WHERE scorer = 'multivector' AND rank <= 3),
ideal AS (SELECT query_id, count(*) AS labels, sum(grade / log2(p + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS p FROM qrels) GROUP BY 1),
got AS (SELECT scorer, query_id, count(*) AS found, min(rank) AS first, sum(grade / log2(rank + 1)) AS dcg FROM runs JOIN qrels USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY ALL),
metrics AS (SELECT k.scorer, i.query_id, round(coalesce(found / labels, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM ideal i CROSS JOIN (VALUES ('dense'), ('sparse')) k(scorer) LEFT JOIN got g ON g.query_id = i.query_id AND g.scorer = k.scorer),
run AS (SELECT query_id, chunk_id, rank FROM runs WHERE scorer = 'dense'),
texts AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE length(trim(content, ' ')) > 0)
"""
MEANS = "count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"
ANCHORS = """
WITH a AS (SELECT point_id AS anchor_id, min(collection) AS collection, min(rel_path) AS rel_path, min(symbol_name) AS symbol, min(start_line) + CASE WHEN min(language) IN ('python', 'go', 'java') THEN 0 ELSE 1 END AS line FROM search_hits GROUP BY 1),
live AS (SELECT DISTINCT chunk_id, collection, rel_path, symbol_name, start_line FROM chunks),
r AS (
  SELECT anchor_id, 1 AS rung, 'chunk_id' AS method, l.chunk_id, 0 AS far, 0 AS start_line FROM a JOIN live l ON l.collection = a.collection AND l.chunk_id = sha256(a.rel_path || ':' || a.line)
  UNION ALL SELECT anchor_id, 2, CASE WHEN count(*) OVER (PARTITION BY anchor_id) = 1 THEN 'content' ELSE 'nearest_line' END, l.chunk_id, coalesce(abs(l.start_line - a.line), 0), l.start_line FROM a JOIN live l ON l.collection = a.collection AND l.rel_path = a.rel_path AND l.symbol_name = a.symbol WHERE length(a.symbol) > 0
  UNION ALL SELECT anchor_id, 3, 'basename', l.chunk_id, coalesce(abs(l.start_line - a.line), 0), l.start_line FROM a JOIN live l ON l.collection = a.collection AND l.rel_path = a.rel_path
  UNION ALL SELECT anchor_id, 4, 'basename', l.chunk_id, coalesce(abs(l.start_line - a.line), 0), l.start_line FROM a JOIN live l ON l.collection = a.collection AND list_last(string_split(replace(l.rel_path, '\\', '/'), '/')) = list_last(string_split(replace(a.rel_path, '\\', '/'), '/'))),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY rung, far, start_line, chunk_id) AS n FROM r),
resolved AS (SELECT a.anchor_id, p.chunk_id, coalesce(p.method, 'unresolved') AS method FROM a LEFT JOIN p ON p.anchor_id = a.anchor_id AND n = 1)
"""
SQL = {
    "delta_classify": STATE + """SELECT coalesce(s.collection, k.collection) AS collection, coalesce(s.path, k.path) AS path, CASE WHEN s.path IS NULL THEN 'stale' WHEN k.path IS NULL THEN 'new'
WHEN coalesce(s.mtime <> 0 AND k.mtime <> 0 AND abs(s.mtime - k.mtime) < 0.001, false) OR coalesce(s.hash = k.hash, false) THEN 'unchanged' ELSE 'modified' END AS change FROM scan s FULL JOIN kept k ON s.collection = k.collection AND s.path = k.path""",
    "node_keys": "SELECT chunk_id AS key, (2 + (collection IS NOT NULL)::INT + (rel_path IS NOT NULL)::INT + (end_line IS NOT NULL)::INT + (language IS NOT NULL)::INT + (symbol_name IS NOT NULL)::INT)::INT AS properties, symbol_name AS name FROM (SELECT DISTINCT * FROM chunks)",
    "unknown_hits": "SELECT DISTINCT point_id FROM search_hits WHERE point_id NOT IN (SELECT point_id FROM chunks)",
    "paths_of_stale_chunks": STATE + "SELECT c.collection, c.rel_path, c.start_line, c.chunk_id FROM (SELECT DISTINCT * FROM chunks) c JOIN scan s ON s.collection = c.collection AND s.path = c.rel_path JOIN kept k ON k.collection = c.collection AND k.path = c.rel_path WHERE NOT (coalesce(s.mtime <> 0 AND k.mtime <> 0 AND abs(s.mtime - k.mtime) < 0.001, false) OR coalesce(s.hash = k.hash, false))",
    "stale_paths": STATE + "SELECT * FROM stale",
    "file_metadata_scan": "SELECT collection, rel_path, file_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY collection, rel_path ORDER BY chunk_id, point_id) AS n FROM (SELECT DISTINCT * FROM chunks) WHERE length(rel_path) > 0) WHERE n = 1",
    "upsert_result": "WITH c AS (SELECT DISTINCT point_id, collection, language, symbol_name FROM chunks) SELECT * FROM c WHERE language = 'go' UNION ALL SELECT point_id, collection, language, lower(symbol_name) FROM c WHERE language IN ('python', 'java')",
    "delete_result": STATE + "SELECT point_id, collection, rel_path FROM (SELECT DISTINCT * FROM chunks) c WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.collection = c.collection AND s.path = c.rel_path)",
    "collection_flags": "SELECT collection, coalesce(max(status <> 'running') FILTER (status = 'failed'), false) AS graph_call_sites, coalesce(max(status <> 'running') FILTER (status <> 'failed'), false) AS graph_enabled FROM index_runs GROUP BY 1",
    "graph_nodes": GRAPH + """SELECT label, key, min(collection) AS collection FROM (SELECT 'Collection' AS label, collection AS key, collection FROM c UNION ALL SELECT 'File', collection || ':' || rel_path, collection FROM c UNION ALL SELECT 'Chunk', chunk_id, collection FROM c
UNION ALL SELECT 'Symbol', collection || ':' || rel_path || '::' || symbol_name, collection FROM defs UNION ALL SELECT 'Symbol', target, collection FROM resolved) GROUP BY 1, 2""",
    "graph_edges": GRAPH + "SELECT * FROM edges",
    "neighbor_keys": GRAPH + "SELECT src AS chunk_id, count(DISTINCT dst) AS keys FROM edges WHERE type IN ('DEFINES', 'CALLS') GROUP BY 1",
    "graph_khop": GRAPH + """, e AS (SELECT DISTINCT src, dst FROM edges WHERE type <> 'IN_COLLECTION'), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h0 AS (SELECT chunk_id AS key FROM c ORDER BY point_id LIMIT 3), h1 AS (SELECT DISTINCT dst AS key FROM b JOIN h0 ON h0.key = b.src WHERE dst NOT IN (SELECT key FROM h0)),
h2 AS (SELECT DISTINCT dst AS key FROM b JOIN h1 ON h1.key = b.src WHERE dst NOT IN (SELECT key FROM h0 UNION SELECT key FROM h1))
SELECT DISTINCT key, 0 AS hop FROM h0 UNION ALL SELECT key, 1 FROM h1 UNION ALL SELECT key, 2 FROM h2""",
    "graph_callers": GRAPH + """, w AS (SELECT DISTINCT token, src AS chunk_id FROM edges WHERE type = 'CALLS' AND token IN (SELECT query_text FROM search_queries)),
r AS (SELECT DISTINCT token, chunk_id, collection, rel_path, start_line, coalesce(symbol_type, 'other') AS symbol_type FROM w JOIN c USING (chunk_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token, collection ORDER BY rel_path, start_line, chunk_id) AS rank FROM r) WHERE rank <= 10""",
    "retrieval_metrics": RUN + "SELECT query_id, recall, mrr, ndcg FROM metrics WHERE scorer = 'dense'",
    "mean_metrics": RUN + f"SELECT {MEANS} FROM metrics WHERE scorer = 'dense'",
    "metrics_by_tag": RUN + f", t AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(tags) > 0 THEN list_distinct(tags) ELSE ['untagged'] END) AS tag FROM search_queries) SELECT tag, {MEANS} FROM metrics JOIN t USING (query_id) WHERE scorer = 'dense' GROUP BY 1",
    "query_stats": RUN + "SELECT r.query_id, count(*) AS retrieved, count_if(q.chunk_id IS NOT NULL AND rank <= 10)::BIGINT AS hits_in_top_k, min(rank) FILTER (q.chunk_id IS NOT NULL) AS first_label_rank, bool_or(q.chunk_id IS NOT NULL AND rank = 1) AS top_hit_in_labels, coalesce((SELECT count(*) FROM qrels x WHERE x.query_id = r.query_id), 0) AS labels FROM run r LEFT JOIN qrels q USING (query_id, chunk_id) GROUP BY r.query_id",
    "baseline_compare": RUN + """, m AS (SELECT scorer, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM metrics GROUP BY 1), u AS (UNPIVOT m ON recall, mrr, ndcg INTO NAME metric VALUE value),
b AS (SELECT s.metric, s.value AS current, d.value AS baseline, round(CASE WHEN d.value = 0 THEN CASE WHEN s.value = 0 THEN 0 ELSE 100 END ELSE (s.value - d.value) / d.value * 100 END, 4) AS delta_percent FROM u s JOIN u d USING (metric) WHERE s.scorer = 'sparse' AND d.scorer = 'dense')
SELECT *, delta_percent < -5 AS regression FROM b""",
    "resolved_anchors": ANCHORS + "SELECT * FROM resolved",
    "drift_report": ANCHORS + "SELECT method, count(*) AS anchors FROM resolved GROUP BY 1",
    "hard_negatives": RUN + ", n AS (SELECT query_id, content, min(rank) AS rank, min_by(chunk_id, (rank, chunk_id)) AS chunk_id FROM run ANTI JOIN qrels USING (query_id, chunk_id) JOIN texts USING (chunk_id) GROUP BY 1, 2) SELECT query_id, chunk_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS position FROM n) WHERE position <= 7",
    "best_positive": RUN + "SELECT query_id, chunk_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS n FROM qrels SEMI JOIN texts USING (chunk_id)) WHERE n = 1",
    "holdout_split": "SELECT query_id, CASE WHEN ('0x' || substring(sha256('42:' || query_id), 1, 8))::BIGINT / 4294967296 < 0.15 THEN 'holdout' ELSE 'train' END AS part FROM (SELECT DISTINCT query_id FROM search_queries)",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
}

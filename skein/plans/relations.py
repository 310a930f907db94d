"""Queries of relations between chunks, files and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import terms, text
from skein.operators import chunking, dependencies, graph, references, relations
from skein.operators.incremental import clean_path
from skein.operators.search import top_per
from skein.plans.search import chunks
from skein.plans.stems import stems_of
from skein.session import table


def newest_files(spark, d):
    """record_id, collection, path, language, content: the newest record with content of every file."""
    rows = table(spark, d, "file_records").where(F.col("content").isNotNull()).select("collection", clean_path(F.col("rel_path")).alias("path"), F.struct("scanned_at", "record_id", "language", "content").alias("s"))
    return rows.groupBy("collection", "path").agg(F.max("s").alias("s")).select("s.record_id", "collection", "path", "s.language", "s.content")


def named_symbols(spark, d):
    """The queries that are the name of a symbol."""
    names = table(spark, d, "search_queries").where(F.col("query_text").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).select(F.col("query_text").alias("symbol_name")).distinct()
    return names


def chunk_windows(spark, d):
    return chunking.windows(newest_files(spark, d))


def line_facts(spark, d):
    return chunking.line_facts(table(spark, d, "file_records").select("record_id", "content").distinct())


def syntax_chunks(spark, d):
    return chunking.syntax_chunks(newest_files(spark, d))


def file_chunks(spark, d):
    """Every file in chunks: definitions below the imports they use, else windows."""
    return chunking.chunk_files(newest_files(spark, d))


def import_names(spark, d):
    return chunking.file_imports(newest_files(spark, d))


def stemmed_tokens(spark, d):
    rows = chunks(spark, d, "content").select(F.explode(text.kept_tokens(F.col("content"))).alias("token")).distinct()
    return rows.select("token", terms.stem_udf("token").alias("stem"))


def token_stems(spark, d):
    rows = chunks(spark, d, "content").select(F.explode(text.kept_tokens(F.col("content"))).alias("token")).distinct()
    return rows.select("token", terms.stem_udf("token").alias("stem"), terms.token_id_udf("token").alias("token_id"))


def chunk_ids(spark, d):
    return chunks(spark, d, "rel_path", "start_line").select("point_id", text.chunk_id(F.col("rel_path"), F.col("start_line")).alias("chunk_id"))


def point_uuids(spark, d):
    return chunks(spark, d, "rel_path", "start_line").select("point_id", text.name_uuid(F.concat_ws(":", "rel_path", F.col("start_line").cast("string"))).alias("uuid"))


def file_languages(spark, d):
    rows = table(spark, d, "file_records").select("collection", clean_path(F.col("rel_path")).alias("path")).distinct()
    return rows.select("collection", "path", text.language_of(F.col("path")).alias("language"), text.excluded(F.col("path")).alias("excluded"))


def file_types(spark, d):
    return chunks(spark, d, "rel_path", "language", "symbol_type").select("point_id", F.coalesce(text.file_symbol_type(F.col("rel_path"), F.col("language")), text.known(F.col("symbol_type"), text.SYMBOL_TYPES)).alias("symbol_type"), text.known(F.col("language"), text.LANGUAGES).alias("language"))


def ignored_files(spark, d):
    pattern = "|".join(filter(None, map(text.ignore_pattern, ["# generated", "web/**", "src/*.py", "/build", "tests/"])))
    return table(spark, d, "file_records").select("collection", clean_path(F.col("rel_path")).alias("path")).distinct().where(F.col("path").rlike(pattern))


def binary_files(spark, d):
    rows = table(spark, d, "file_records").where(F.col("content").isNotNull()).select("record_id", "content").distinct()
    return rows.select("record_id", F.instr(F.substring("content", 1, 512), "\0").cast("boolean").alias("binary"), F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))


def truncated_chunks(spark, d):
    cut, was = text.truncated(F.col("content"), 200)
    return chunks(spark, d, "content").select("point_id", cut.alias("content"), was.alias("truncated"))


def rounded_scores(spark, d):
    rows = table(spark, d, "search_hits").where(F.col("score").isNotNull() & ~F.isnan("score")).select("query_id", "scorer", "point_id", "logged_at", "score").distinct()
    return rows.select("query_id", "scorer", "point_id", "logged_at", F.bround("score", 2).alias("score"))


def dir_tree(spark, d):
    rows = table(spark, d, "file_records").select("collection", clean_path(F.col("rel_path")).alias("path")).distinct()
    return rows.select("collection", F.explode(text.folder_prefixes(F.col("path"))).alias("folder")).where(F.col("folder").isNotNull()).distinct()


def calling(spark, d):
    """What relations.calls reads."""
    return chunks(spark, d, "collection", "rel_path", "content")


def defining(spark, d, *more):
    """What relations.definitions reads, and ``more``."""
    return chunks(spark, d, "collection", "rel_path", "symbol_name", *more)


def callees(spark, d):
    return relations.calls(calling(spark, d)).select("point_id", "token")


def routes(spark, d):
    return chunks(spark, d, "content", "rel_path").select("point_id", F.explode(text.route_paths(F.col("content"), F.col("rel_path"))).alias("route"))


def urls(spark, d):
    found = text.config_urls(F.col("content"))
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("content")).distinct()
    return rows.select("doc_id", F.size(found["paths"]).alias("paths"), F.size(found["base_urls"]).alias("base_urls"), F.size(text.code_urls(F.col("content"))).alias("code_urls")).where("paths + base_urls + code_urls > 0")


def classify_refs(spark, d):
    rows = chunks(spark, d, "content", "symbol_name", "rel_path")
    return rows.select("point_id", text.reference_type(F.col("content"), F.coalesce("symbol_name", F.lit("")), F.col("rel_path")).alias("reference_type"), text.http_verb(F.coalesce("content", F.lit(""))).alias("verb"))


def normal_names(spark, d):
    return table(spark, d, "chunks").where(F.col("symbol_name").isNotNull()).select("symbol_name", text.normal_name(F.col("symbol_name")).alias("name")).distinct()


def resolved_calls(spark, d):
    imports = relations.call_imports(chunks(spark, d, "collection", "rel_path", "language", "start_line", "content"), newest_files(spark, d))
    return relations.resolve_calls(relations.calls(calling(spark, d)), relations.definitions(defining(spark, d)), imports).select("point_id", "token", "target")


def url_path_match(spark, d):
    """Folders of files as callers' and endpoints' paths."""
    rows = table(spark, d, "chunks").select("collection", F.regexp_replace("rel_path", "/[^/]*$", "").alias("path")).where(F.col("path").contains("/")).distinct()
    return relations.matching_paths(rows, rows)


def dep_name_match(spark, d):
    """Each run's collection under the suffix of the run's turn, as an artifact of a group that may be a collection itself."""
    suffixes = F.array(*map(F.lit, [*text.NAME_SUFFIXES, "-extra_v2", ".x"]))
    runs = table(spark, d, "index_runs").select("run_id", "collection").distinct()
    deps = runs.select(F.concat(F.replace("collection", F.lit("-"), F.lit("_")), F.element_at(suffixes, (F.pmod(F.col("run_id"), F.lit(len(text.NAME_SUFFIXES) + 2)) + 1).cast("int"))).alias("artifact"), F.concat(F.lit("com."), "collection").alias("group"), F.lit("").alias("self"))
    return relations.match_dependencies(deps, runs.select("collection").distinct())


def manifest_deps(spark, d):
    return dependencies.dependencies(newest_files(spark, d).select("collection", "path", "content"))


def shared_symbols(spark, d):
    return relations.shared_symbols(defining(spark, d))


def symbol_locations(spark, d):
    return relations.symbol_locations(defining(spark, d, "content"))


def find_symbols(spark, d):
    return relations.find_symbols(defining(spark, d, "start_line"), named_symbols(spark, d))


def find_callers(spark, d):
    return relations.find_callers(relations.calls(calling(spark, d)), named_symbols(spark, d))


def missing_symbols(spark, d):
    """Collections in which a named symbol is not defined."""
    found = relations.find_symbols(defining(spark, d, "start_line"), named_symbols(spark, d), 1).select("symbol_name", "collection")
    all_of = table(spark, d, "chunks").agg(F.collect_set("collection").alias("all"))  # one row; collections are few
    held = found.groupBy("symbol_name").agg(F.collect_set("collection").alias("held")).join(F.broadcast(all_of))
    return held.select("symbol_name", F.explode(F.array_except("all", "held")).alias("collection"))


def cross_references(spark, d):
    return relations.cross_references(defining(spark, d, "start_line"), relations.calls(calling(spark, d)), named_symbols(spark, d))


def _searched(spark, d, scorer):
    """The first ten hits of a scorer for every query that is a symbol's name, of a score of 0.3 or more."""
    hits = table(spark, d, "search_hits").where((F.col("scorer") == scorer) & (F.col("score") >= 0.3) & ~F.isnan("score")).select("query_id", "point_id", "score").join(_named_queries(spark, d), "query_id")
    best = hits.groupBy("symbol_name", "point_id").agg(F.max("score").alias("score"))
    return top_per(best, ["symbol_name"], [F.desc("score"), F.col("point_id")], 10).select("symbol_name", "point_id", "score")


def _named_queries(spark, d):
    """query_id, symbol_name of the queries that are a name; narrow, and as many as people ask."""
    return table(spark, d, "search_queries").where(F.col("query_text").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).select("query_id", F.col("query_text").alias("symbol_name")).distinct()


def _references(spark, d):
    """Merged references of the named symbols with their chunks: dense hits, definitions, sparse hits, and call sites."""
    c = defining(spark, d, "start_line", "content")
    names = named_symbols(spark, d)
    exact = relations.find_symbols(c, names, 10).select("symbol_name", "point_id", F.lit(1.0).alias("score"))
    called = relations.find_callers(relations.calls(calling(spark, d)), names).select(F.col("token").alias("symbol_name"), "point_id", F.lit(1.0).alias("score"))
    rows = None
    for kind, part in zip(references.MATCH_TYPES, (_searched(spark, d, "dense"), exact, _searched(spark, d, "sparse"), called)):
        part = part.withColumn("match_type", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    place = c.select("point_id", "collection", "rel_path", "start_line", "content", F.col("symbol_name").alias("own_symbol"))
    rows = rows.join(place, "point_id").withColumn("reference_type", text.reference_type(F.col("content"), F.col("symbol_name"), F.col("rel_path")))
    kept = rows.groupBy("symbol_name", "collection", "rel_path", "start_line").agg(F.max(F.struct("point_id", "content", "own_symbol")).alias("c"))
    out = references.merged(rows)
    same = [out[k].eqNullSafe(kept[k]) for k in ("symbol_name", "collection", "rel_path", "start_line")]
    return out.join(kept, same[0] & same[1] & same[2] & same[3]).select(*[out[k] for k in out.columns], "c.content", "c.own_symbol")


def merged_references(spark, d):
    return _references(spark, d).drop("content", "own_symbol").withColumn("score", F.round("score", 6))


def reference_links(spark, d):
    return references.links(_references(spark, d)).withColumn("paths", F.array_join("paths", ","))


def routed_callers(spark, d):
    """Callers of the named symbols: by the graph's edges in collections with a completed run, by call lists in the others."""
    from skein.plans.state import _graph

    names = named_symbols(spark, d).select(F.col("symbol_name").alias("token"))
    c = chunks(spark, d, "chunk_id", "collection", "rel_path", "start_line", "symbol_type")
    by_graph = graph.callers(_graph(spark, d)[2], c, names).select("token", "collection", "rel_path", "chunk_id", F.lit("graph").alias("by"))
    by_calls = relations.find_callers(relations.calls(calling(spark, d)), named_symbols(spark, d)).join(c.select("point_id", "chunk_id"), "point_id")
    flags = table(spark, d, "index_runs").groupBy("collection").agg(F.bool_or(F.col("status") == "completed").alias("graph_call_sites"))
    return references.routed_callers(by_graph, by_calls.select("token", "collection", "rel_path", "chunk_id", F.lit("calls").alias("by")), flags)


def symbol_usages(spark, d):
    return relations.usages(defining(spark, d, "content"), named_symbols(spark, d))


def service_edges(spark, d):
    return relations.service_edges(relations.calls(calling(spark, d)), relations.definitions(defining(spark, d)))


def service_adjacency(spark, d):
    return relations.adjacency(service_edges(spark, d))


# What a chunk may be to a symbol.
KINDS = "definition endpoint_definition http_call service_config build_dependency import usage".split()


def service_summary(spark, d):
    kinds = classify_refs(spark, d).join(chunks(spark, d, "collection"), "point_id")
    return kinds.groupBy("collection").agg(F.count("*").alias("chunks"), *[F.count_if(F.col("reference_type") == k).alias(k) for k in KINDS])


def collection_summary(spark, d):
    return relations.collection_summary(defining(spark, d, "language"))


def files_per_language(spark, d):
    files = chunks(spark, d, "collection", "rel_path", "language").groupBy("collection", "rel_path").agg(F.min("language").alias("language"))
    return files.groupBy("collection", "language").agg(F.count("*").alias("files"))


def chunks_per_type(spark, d):
    return chunks(spark, d, "collection", "symbol_type").groupBy("collection", "symbol_type").agg(F.count("*").alias("chunks"))


def top_chunked_files(spark, d):
    files = chunks(spark, d, "collection", "rel_path").groupBy("collection", "rel_path").agg(F.count("*").alias("chunks"))
    return top_per(files, ["collection"], [F.desc("chunks"), F.col("rel_path")], 10)


def file_outline(spark, d):
    """Symbols of every file in line order."""
    rows = defining(spark, d, "start_line").select(F.struct("start_line", "point_id", F.coalesce("symbol_name", F.lit("?")).alias("name")).alias("s"), "collection", "rel_path")
    return rows.groupBy("collection", "rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["name"]), " ").alias("outline"))


def merged_files(spark, d):
    return relations.merged_files(chunks(spark, d, "collection", "rel_path", "start_line", "content")).select("collection", "rel_path", F.length("content").alias("length"), F.md5("content").alias("digest"))


def results_by_collection(spark, d):
    rows = table(spark, d, "search_hits").select("query_id", "collection", "chunk_id").distinct()
    return rows.groupBy("query_id", "collection").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunks"))


def list_collections(spark, d):
    c = chunks(spark, d, "collection").groupBy("collection").agg(F.count("*").alias("points"))
    runs = table(spark, d, "index_runs").distinct().groupBy("collection").agg(F.count("*").alias("runs"), F.max("finished_at").alias("last_finished"))
    return c.join(runs, "collection", "full")


def find_chunk(spark, d):
    """Every chunk id with the first collection, by name, that holds it."""
    return chunks(spark, d, "chunk_id", "collection").groupBy("chunk_id").agg(F.min("collection").alias("collection"), F.count("*").alias("held"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_windows, line_facts, syntax_chunks, file_chunks, import_names, stemmed_tokens, token_stems, chunk_ids, point_uuids, file_languages, file_types, ignored_files, binary_files, truncated_chunks, rounded_scores, dir_tree, callees, routes, urls,
        classify_refs, normal_names, resolved_calls, url_path_match, dep_name_match, manifest_deps, shared_symbols, symbol_locations, find_symbols, find_callers, missing_symbols, cross_references, merged_references, reference_links, routed_callers,
        symbol_usages, service_edges, service_adjacency, service_summary, collection_summary, files_per_language, chunks_per_type, top_chunked_files, file_outline, merged_files, results_by_collection,
        list_collections, find_chunk,
    )
}


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


CLEAN = r"regexp_replace(replace(rel_path, '\', '/'), '^\./', '')"
C = "WITH c AS (SELECT DISTINCT * FROM chunks)"
FILES = f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY scanned_at DESC NULLS LAST, record_id DESC) AS rn FROM (SELECT DISTINCT record_id, collection, {CLEAN} AS path, language, content, scanned_at FROM file_records WHERE content IS NOT NULL)), f AS (SELECT record_id, collection, path, language, content FROM n WHERE rn = 1)"
MEMBER = r"([A-Za-z_][A-Za-z0-9_$]*)\s*\.\s*([A-Za-z_][A-Za-z0-9_$]*)\s*\("
WORDS = "(" + ", ".join(f"'{w}'" for w in text.NOT_CALLED) + ")"
CALLS = (
    C
    + rf""", pairs AS (SELECT point_id, collection, rel_path, unnest(list_zip(regexp_extract_all(content, '{MEMBER}', 1), regexp_extract_all(content, '{MEMBER}', 2))) AS p FROM c),
calls AS (
  SELECT DISTINCT point_id, collection, rel_path, token FROM (
    SELECT point_id, collection, rel_path, p[2] AS token FROM pairs WHERE p[2] NOT IN {WORDS}
    UNION ALL SELECT point_id, collection, rel_path, p[1] || '.' || p[2] FROM pairs WHERE p[2] NOT IN {WORDS} AND p[1] NOT IN {WORDS}
    UNION ALL SELECT point_id, collection, rel_path, t FROM (SELECT point_id, collection, rel_path, unnest(regexp_extract_all(content, '\b([A-Za-z_][A-Za-z0-9_$]*)\s*\(', 1)) AS t FROM c) WHERE t NOT IN {WORDS})),
defs AS (SELECT DISTINCT collection, rel_path, symbol_name FROM c WHERE length(symbol_name) > 0),
names AS (SELECT DISTINCT query_text AS symbol_name FROM search_queries WHERE regexp_matches(query_text, '^[A-Za-z_][A-Za-z0-9_]*$'))"""
)
SUFFIX_CASE = "CASE " + " ".join(f"WHEN n LIKE '%{s}' THEN left(n, length(n) - {len(s)})" for s in text.NAME_SUFFIXES) + " ELSE n END"
CONFIGURED = f"regexp_matches(rel_path, '{_re2(text.CONFIG_FILE)}') AND (" + " OR ".join(f"regexp_matches(content, '{_re2(p)}')" for p in text.config_patterns()) + ")"
KIND = rf"""CASE WHEN {CONFIGURED} THEN 'service_config' WHEN regexp_matches(content, '{_re2(text.CLASS_HEAD)}') AND length(coalesce(symbol_name, '')) > 0 AND regexp_matches(content, '(?:class|interface|enum|record)\s+' || symbol_name || '\b') THEN 'definition'
WHEN regexp_matches(content, '{_re2(text.ENDPOINT)}') THEN 'endpoint_definition' WHEN regexp_matches(content, '{_re2(text.HTTP_CALL)}') THEN 'http_call' WHEN regexp_matches(content, '{_re2(text.IMPORT)}') THEN 'import' ELSE 'usage' END"""
# the kind of a chunk to the symbol that is looked up, not to the one it defines
KIND_OF = KIND.replace("coalesce(symbol_name, '')", "lookup").replace("|| symbol_name ||", "|| lookup ||")
REFERENCES = CALLS + f""", qn AS (SELECT DISTINCT query_id, query_text AS lookup FROM search_queries WHERE regexp_matches(query_text, '^[A-Za-z_][A-Za-z0-9_]*$')),
hit AS (SELECT scorer, lookup, point_id, max(score) AS score FROM search_hits JOIN qn USING (query_id) WHERE score >= 0.3 AND NOT isnan(score) GROUP BY ALL),
m AS (
  SELECT lookup, point_id, score, CASE scorer WHEN 'dense' THEN 1 ELSE 3 END AS o FROM (SELECT *, row_number() OVER (PARTITION BY scorer, lookup ORDER BY score DESC, point_id) AS n FROM hit WHERE scorer IN ('dense', 'sparse')) WHERE n <= 10
  UNION ALL SELECT symbol_name, point_id, 1.0, 2 FROM (SELECT *, row_number() OVER (PARTITION BY symbol_name, collection ORDER BY rel_path, start_line, point_id) AS n FROM c SEMI JOIN names USING (symbol_name)) WHERE n <= 10
  UNION ALL SELECT token, point_id, 1.0, 4 FROM (SELECT *, row_number() OVER (PARTITION BY token, collection ORDER BY rel_path, point_id) AS n FROM calls WHERE token IN (SELECT symbol_name FROM names)) WHERE n <= 10),
x AS (SELECT *, {KIND_OF} AS t FROM (SELECT m.lookup, m.score, m.o, c.* FROM m JOIN c USING (point_id))),
merged AS (SELECT lookup AS symbol_name, collection, rel_path, start_line, CASE WHEN max(o) = 4 THEN 'call_site' ELSE ['semantic', 'exact_symbol', 'import_search'][min(o)] END AS match_type,
  CASE WHEN max(o) = 4 THEN 1.0 ELSE -min_by(-score, (o, -score, t)) END AS score, CASE WHEN max(o) = 4 THEN 'call_site' ELSE min_by(t, (o, -score, t)) END AS reference_type, max_by(content, (point_id, content)) AS content, max_by(symbol_name, (point_id, content)) AS own_symbol
  FROM x GROUP BY 1, 2, 3, 4)
"""
VERB = f"lower(regexp_extract(coalesce(content, ''), '{_re2(text.VERB)}', 0))"
SUFFIXES = {s: language for language, ss in text.SUFFIX_LANGUAGES.items() for s in ss}
LANGUAGE_OF = (
    "coalesce(CASE name " + " ".join(f"WHEN '{n}' THEN '{g}'" for n, g in text.NAME_LANGUAGES.items()) + " END, CASE first " + " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in SUFFIXES.items()) + " END, CASE last " + " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in SUFFIXES.items()) + " END)"
)
IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
ROUTE = " || ".join(f"regexp_extract_all(content, '{_re2(p)}', 1)" for p in text.ROUTES)
CONFIG = " || ".join(f"regexp_extract_all(content, '{_re2(p)}', 1)" for p in text.config_patterns())
CODE = " || ".join(f"regexp_extract_all(content, '{_re2(p)}', 1)" for p in text.code_patterns())

SQL = {
    "chunk_windows": FILES + rf""", l AS (SELECT collection, path, language, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS lines, CASE WHEN language IN {IN(chunking.VERBOSE)} THEN 60 ELSE 150 END AS size, CASE WHEN language IN {IN(chunking.VERBOSE)} THEN 10 ELSE 20 END AS overlap FROM f WHERE length(content) > 0),
w AS (SELECT *, unnest(range(0, greatest(0, ceil((len(lines) - size) / (size - overlap)))::BIGINT + 1)) * (size - overlap) AS start FROM l)
SELECT collection, path, language, (start + 1)::INT AS start_line, least(start + size, len(lines))::INT AS end_line, array_to_string(list_slice(lines, start + 1, start + size), chr(10)) AS content, sha256(path || ':' || (start + 1)::INT::VARCHAR) AS chunk_id FROM w""",
    "line_facts": r"SELECT record_id, len(string_split(content, chr(10)))::INT AS lines, list_max(list_transform(string_split(content, chr(10)), lambda x: length(regexp_replace(x, '\r$', ''))))::INT AS longest, contains(content, chr(13) || chr(10)) AS returns FROM (SELECT DISTINCT record_id, content FROM file_records)",
    "stemmed_tokens": "WITH ws AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{Nd}_$]+'), lambda t: length(t) <= 40)) AS word FROM chunks),\n" + stems_of("ws") + "\nSELECT word AS token, stem FROM stems",
    "chunk_ids": C + " SELECT point_id, sha256(rel_path || ':' || start_line) AS chunk_id FROM c",
    "point_uuids": C + f", u AS (SELECT point_id, sha1(unhex('{text.POINT_SPACE}') || encode(rel_path || ':' || start_line)) AS h FROM c) SELECT point_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(position(h[17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM u",
    "file_languages": f"WITH p AS (SELECT DISTINCT collection, {CLEAN} AS path FROM file_records), x AS (SELECT *, list_last(string_split(path, '/')) AS name FROM p), y AS (SELECT *, regexp_extract(lower(name), '^[^.]*(\\..*)$', 1) AS first, regexp_extract(lower(name), '(\\.[^.]*)$', 1) AS last, string_split(path, '/') AS parts FROM x) SELECT collection, path, {LANGUAGE_OF} AS language, list_has_any(list_slice(parts, 1, len(parts) - 1), [{', '.join(chr(39) + e + chr(39) for e in text.EXCLUDED)}]) OR len(list_filter(list_slice(parts, 1, len(parts) - 1), lambda q: starts_with(q, '.venv'))) > 0 OR (regexp_matches(path, '(^|/)\\.github/') AND NOT regexp_matches(path, '(^|/)\\.github/workflows/')) AS excluded FROM y",
    "file_types": C + f", n AS (SELECT *, lower(replace(rel_path, '\\', '/')) AS norm FROM c), m AS (SELECT *, list_last(string_split(norm, '/')) AS name FROM n) SELECT point_id, CASE WHEN name IN {IN([m.lower() for m in text.MANIFESTS])} THEN 'manifest' WHEN name IN ('.env', '.env.example', '.env.local') OR regexp_matches(norm, '\\.(?:properties|ini|cfg|toml)$') THEN 'config' WHEN language = 'yaml' AND (contains(norm, '.github/workflows/') OR contains(norm, 'templates/')) THEN 'ops' WHEN language = 'yaml' THEN 'config' WHEN symbol_type IN {IN(text.SYMBOL_TYPES)} THEN symbol_type ELSE 'other' END AS symbol_type, CASE WHEN language IN {IN(text.LANGUAGES)} THEN language ELSE 'unknown' END AS language FROM m",
    "ignored_files": f"SELECT * FROM (SELECT DISTINCT collection, {CLEAN} AS path FROM file_records) WHERE regexp_matches(path, '^web/.*(?:/|$)|^src/[^/]*\\.py(?:/|$)|^build$|^tests/(?:/|$)')",
    "binary_files": "SELECT record_id, contains(substring(content, 1, 512), chr(0)) AS \"binary\", sha256(content) AS hash FROM (SELECT DISTINCT record_id, content FROM file_records WHERE content IS NOT NULL)",
    "truncated_chunks": C + " SELECT point_id, substring(content, 1, 200) AS content, length(content) > 200 AS truncated FROM c",
    "rounded_scores": "SELECT query_id, scorer, point_id, logged_at, round_even(score, 2) AS score FROM (SELECT DISTINCT query_id, scorer, point_id, logged_at, score FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score))",
    "dir_tree": f"WITH p AS (SELECT DISTINCT collection, string_split({CLEAN}, '/') AS parts FROM file_records), x AS (SELECT collection, parts, unnest([1, 2]) AS n FROM p) SELECT DISTINCT collection, array_to_string(list_slice(parts, 1, n), '/') AS folder FROM x WHERE n < len(parts)",
    "callees": CALLS + " SELECT point_id, token FROM calls",
    "routes": C + f", r AS (SELECT point_id, unnest({ROUTE}) AS raw FROM c) SELECT point_id, trim(raw, '/') AS route FROM r WHERE length(trim(raw, '/')) > 1",
    "urls": f"WITH d AS (SELECT DISTINCT doc_id, text AS content FROM documents), x AS (SELECT doc_id, {CONFIG} AS f, {CODE} AS k FROM d), y AS (SELECT doc_id, len(list_filter(f, lambda p: NOT starts_with(lower(p), 'http') AND length(trim(p, '/')) > 2))::INT AS paths, len(list_filter(f, lambda p: starts_with(lower(p), 'http')))::INT AS base_urls, len(list_filter(k, lambda p: length(trim(p, '/')) > 2))::INT AS code_urls FROM x) SELECT * FROM y WHERE paths + base_urls + code_urls > 0",
    "classify_refs": C + f" SELECT point_id, {KIND} AS reference_type, CASE WHEN contains({VERB}, 'get') THEN 'GET' WHEN contains({VERB}, 'post') THEN 'POST' WHEN contains({VERB}, 'put') THEN 'PUT' WHEN contains({VERB}, 'delete') THEN 'DELETE' WHEN contains({VERB}, 'patch') THEN 'PATCH' ELSE '' END AS verb FROM c",
    "normal_names": C + f", n AS (SELECT DISTINCT symbol_name, translate(lower(symbol_name), '_.', '--') AS n FROM c WHERE symbol_name IS NOT NULL) SELECT symbol_name, {SUFFIX_CASE} AS name FROM n",
    "resolved_calls": CALLS + """, s AS (SELECT collection, symbol_name, min(collection || ':' || rel_path || '::' || symbol_name) AS target FROM defs GROUP BY 1, 2 HAVING count(*) = 1)
SELECT k.point_id, k.token, coalesce(e.target, m.target, k.collection || '::callee::' || k.token) AS target FROM calls k LEFT JOIN s e ON e.collection = k.collection AND e.symbol_name = k.token
LEFT JOIN s m ON m.collection = k.collection AND contains(k.token, '.') AND m.symbol_name = list_last(string_split(k.token, '.'))""",
    "url_path_match": C + r""", p AS (SELECT DISTINCT collection, regexp_replace(rel_path, '/[^/]*$', '') AS path FROM c WHERE contains(regexp_replace(rel_path, '/[^/]*$', ''), '/')),
n AS (SELECT *, trim(regexp_replace(lower(regexp_replace(path, '\{[^}]+\}', '', 'g')), '/+', '/', 'g'), '/') AS norm FROM p)
SELECT DISTINCT a.collection AS caller_collection, a.path AS caller, b.collection AS endpoint_collection, b.path AS endpoint FROM n a JOIN n b ON a.collection <> b.collection AND contains(a.norm, '/') AND contains(b.norm, '/') AND (contains('/' || a.norm || '/', '/' || b.norm || '/') OR contains('/' || b.norm || '/', '/' || a.norm || '/'))""",
    "dep_name_match": f"""WITH r AS (SELECT DISTINCT run_id, collection FROM index_runs), d AS (SELECT DISTINCT replace(collection, '-', '_') || ([{', '.join(chr(39) + s + chr(39) for s in [*text.NAME_SUFFIXES, '-extra_v2', '.x'])}])[run_id % {len(text.NAME_SUFFIXES) + 2} + 1] AS artifact, 'com.' || collection AS grp FROM r),
a AS (SELECT artifact, {SUFFIX_CASE} AS a, grp FROM (SELECT *, translate(lower(artifact), '_.', '--') AS n FROM d)), g AS (SELECT artifact, a, {SUFFIX_CASE} AS g FROM (SELECT *, translate(lower(grp), '_.', '--') AS n FROM a)),
k AS (SELECT collection, {SUFFIX_CASE} AS c FROM (SELECT DISTINCT collection, translate(lower(collection), '_.', '--') AS n FROM r))
SELECT artifact, collection, min(CASE WHEN a = c OR g = c THEN 'exact' ELSE 'fuzzy' END) AS confidence FROM g, k WHERE a = c OR g = c OR (length(a) >= 4 AND (contains(c, a) OR contains(a, c))) OR (length(g) >= 4 AND (contains(c, g) OR contains(g, c))) GROUP BY 1, 2""",
    "shared_symbols": C + " SELECT symbol_name, count(DISTINCT collection) AS collections, string_agg(DISTINCT collection, ',' ORDER BY collection) AS names FROM c WHERE length(symbol_name) > 0 GROUP BY 1 HAVING count(DISTINCT collection) >= 2",
    "symbol_locations": C + f", s AS (SELECT symbol_name FROM c WHERE length(symbol_name) > 0 GROUP BY 1 HAVING count(DISTINCT collection) >= 2) SELECT DISTINCT symbol_name, collection, rel_path, {KIND} AS reference_type FROM c SEMI JOIN s USING (symbol_name)",
    "find_symbols": CALLS + " SELECT symbol_name, collection, rel_path, start_line, point_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol_name, collection ORDER BY rel_path, start_line, point_id) AS rank FROM c SEMI JOIN names USING (symbol_name)) WHERE rank <= 3",
    "find_callers": CALLS + " SELECT token, collection, rel_path, point_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY token, collection ORDER BY rel_path, point_id) AS rank FROM calls WHERE token IN (SELECT symbol_name FROM names)) WHERE rank <= 10",
    "missing_symbols": CALLS + ", f AS (SELECT DISTINCT symbol_name, collection FROM c SEMI JOIN names USING (symbol_name)) SELECT s.symbol_name, k.collection FROM (SELECT DISTINCT symbol_name FROM f) s, (SELECT DISTINCT collection FROM c) k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.symbol_name = s.symbol_name AND f.collection = k.collection)",
    "cross_references": CALLS + """, x AS (
SELECT symbol_name, collection, rel_path, start_line, 'exact_symbol' AS match_type, 0.9::DOUBLE AS score, 1 AS o FROM c SEMI JOIN names USING (symbol_name)
UNION ALL SELECT k.token, k.collection, k.rel_path, c.start_line, 'call_site', 1.0::DOUBLE, 0 FROM calls k JOIN c USING (point_id) WHERE k.token IN (SELECT symbol_name FROM names))
SELECT symbol_name, collection, rel_path, start_line, min_by(match_type, o) AS match_type, min_by(score, o) AS score FROM x GROUP BY 1, 2, 3, 4""",
    "merged_references": REFERENCES + "SELECT symbol_name, collection, rel_path, start_line, match_type, round(score, 6) AS score, reference_type FROM merged",
    "reference_links": REFERENCES + """, d AS (SELECT DISTINCT symbol_name, collection, rel_path, coalesce(own_symbol, '') AS own FROM merged WHERE reference_type = 'definition'),
l AS (SELECT DISTINCT s.symbol_name, s.collection AS from_collection, s.rel_path AS from_path, d.collection AS to_collection, d.rel_path AS to_path FROM merged s JOIN d USING (symbol_name) WHERE s.reference_type = 'call_site' AND (own = '' OR own = symbol_name)
UNION SELECT s.symbol_name, s.collection, s.rel_path, d.collection, d.rel_path FROM merged s JOIN d USING (symbol_name) WHERE s.reference_type IN ('usage', 'import') AND s.collection <> d.collection AND (own = '' OR contains(s.content, own)))
SELECT *, 'code_dependency' AS kind, '' AS paths FROM l""",
    "routed_callers": CALLS + """, flags AS (SELECT collection, bool_or(status = 'completed') AS f FROM index_runs GROUP BY 1), k AS (SELECT token, collection, rel_path, point_id, chunk_id, start_line FROM (SELECT DISTINCT token, collection, rel_path, point_id FROM calls WHERE token IN (SELECT symbol_name FROM names)) JOIN (SELECT DISTINCT point_id, chunk_id, start_line FROM chunks) USING (point_id)),
g AS (SELECT token, collection, rel_path, chunk_id, row_number() OVER (PARTITION BY token, collection ORDER BY rel_path, start_line, chunk_id) AS n FROM (SELECT DISTINCT token, collection, rel_path, chunk_id, start_line FROM k)),
a AS (SELECT token, collection, rel_path, chunk_id, row_number() OVER (PARTITION BY token, collection ORDER BY rel_path, point_id) AS n FROM k)
SELECT token, collection, rel_path, chunk_id, 'graph' AS "by" FROM g WHERE n <= 10 AND collection IN (SELECT collection FROM flags WHERE f) UNION ALL SELECT token, collection, rel_path, chunk_id, 'calls' FROM a WHERE n <= 10 AND collection NOT IN (SELECT collection FROM flags WHERE f)""",
    "symbol_usages": CALLS + " SELECT DISTINCT a.symbol_name, a.collection AS defined_in, b.collection AS used_in FROM c a JOIN names USING (symbol_name) JOIN c b ON a.collection <> b.collection AND contains(b.content, a.symbol_name)",
    "service_edges": CALLS + ", h AS (SELECT symbol_name, min(collection) AS \"to\" FROM defs GROUP BY 1 HAVING count(DISTINCT collection) = 1) SELECT k.collection AS \"from\", h.\"to\", count(DISTINCT k.token) AS tokens FROM calls k JOIN h ON h.symbol_name = k.token WHERE k.collection <> h.\"to\" GROUP BY 1, 2",
    "service_adjacency": CALLS + ", h AS (SELECT symbol_name, min(collection) AS t FROM defs GROUP BY 1 HAVING count(DISTINCT collection) = 1), e AS (SELECT DISTINCT k.collection AS f, h.t FROM calls k JOIN h ON h.symbol_name = k.token WHERE k.collection <> h.t), o AS (SELECT f AS service, string_agg(t, ',' ORDER BY t) AS calls FROM e GROUP BY 1), i AS (SELECT t AS service, string_agg(f, ',' ORDER BY f) AS called_by FROM e GROUP BY 1) SELECT service, coalesce(calls, '') AS calls, coalesce(called_by, '') AS called_by FROM o FULL JOIN i USING (service)",
    "service_summary": C + f", k AS (SELECT collection, {KIND} AS t FROM c) SELECT collection, count(*) AS chunks, " + ", ".join(f"count_if(t = '{k}')::BIGINT AS {k}" if k != "import" else "count_if(t = 'import')::BIGINT AS \"import\"" for k in KINDS) + " FROM k GROUP BY 1",
    "collection_summary": C + ", f AS (SELECT collection, rel_path, count(*) AS n, min(language) AS language FROM c GROUP BY 1, 2), s AS (SELECT collection, count(DISTINCT symbol_name) AS symbols FROM c WHERE length(symbol_name) > 0 GROUP BY 1) SELECT collection, count(*) AS files, sum(n)::BIGINT AS chunks, count(DISTINCT language) AS languages, coalesce(first(symbols), 0) AS symbols FROM f LEFT JOIN s USING (collection) GROUP BY 1",
    "files_per_language": C + ", f AS (SELECT collection, rel_path, min(language) AS language FROM c GROUP BY 1, 2) SELECT collection, language, count(*) AS files FROM f GROUP BY 1, 2",
    "chunks_per_type": C + " SELECT collection, symbol_type, count(*) AS chunks FROM c GROUP BY 1, 2",
    "top_chunked_files": C + ", f AS (SELECT collection, rel_path, count(*) AS chunks FROM c GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY chunks DESC, rel_path) AS rank FROM f) WHERE rank <= 10",
    "file_outline": C + " SELECT collection, rel_path, string_agg(coalesce(symbol_name, '?'), ' ' ORDER BY start_line, point_id) AS outline FROM c GROUP BY 1, 2",
    "merged_files": C + ", m AS (SELECT collection, rel_path, string_agg(chr(10) || coalesce(content, ''), '' ORDER BY start_line, point_id) AS content FROM c GROUP BY 1, 2) SELECT collection, rel_path, length(content)::INT AS length, md5(content) AS digest FROM m",
    "results_by_collection": "SELECT query_id, collection, count(*) AS hits, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunks FROM (SELECT DISTINCT query_id, collection, chunk_id FROM search_hits) GROUP BY 1, 2",
    "list_collections": C + ", a AS (SELECT collection, count(*) AS points FROM c GROUP BY 1), b AS (SELECT collection, count(*) AS runs, max(finished_at) AS last_finished FROM (SELECT DISTINCT * FROM index_runs) GROUP BY 1) SELECT * FROM a FULL JOIN b USING (collection)",
    "find_chunk": C + " SELECT chunk_id, min(collection) AS collection, count(*) AS held FROM c GROUP BY 1",
}

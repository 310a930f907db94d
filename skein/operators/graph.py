"""The property graph of chunks, files, symbols and collections, and walks over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import relations
from skein.operators.search import top_per
from skein.session import cut

#: Labels that connect everything; a walk passes them only if asked to.
HUBS = ["Collection"]
#: Edges that lead to them.
HUB_TYPES = ["IN_COLLECTION", "RESOLVES_TO"]


def nodes(chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """label, key, collection; one row per label and key."""
    c = F.col("collection")
    parts = [
        chunks.select(F.lit("Collection").alias("label"), c.alias("key"), c),
        chunks.select(F.lit("File"), F.concat_ws(":", c, "rel_path"), c),
        chunks.select(F.lit("Chunk"), F.col("chunk_id"), c),
        relations.definitions(chunks).select(F.lit("Symbol"), text.symbol_key(c, F.col("rel_path"), F.col("symbol_name")), c),
        resolved.select(F.lit("Symbol"), "target", c),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("label", "key").agg(F.min("collection").alias("collection"))


def edges(chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """type, src, dst, token: IN_COLLECTION, IN_FILE, DEFINES, CALLS. Two tokens that mean one symbol are two edges."""
    file_key = F.concat_ws(":", "collection", "rel_path")
    ids = chunks.select("point_id", "chunk_id").distinct()
    parts = [
        chunks.select(F.lit("IN_COLLECTION").alias("type"), file_key.alias("src"), F.col("collection").alias("dst"), F.lit("").alias("token")),
        chunks.select(F.lit("IN_FILE"), "chunk_id", file_key, F.lit("")),
        chunks.where(F.length("symbol_name") > 0).select(F.lit("DEFINES"), "chunk_id", text.symbol_key(F.col("collection"), F.col("rel_path"), F.col("symbol_name")), F.lit("")),
        resolved.join(ids, "point_id").select(F.lit("CALLS"), "chunk_id", "target", "token"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


# What a node is known by, the first that it has; and what is kept of it.
KEY_FIELDS = ["chunk_id", "qualified_name", "path", "rel_path", "name", "key"]
PROPERTIES = ["chunk_id", "qualified_name", "name", "kind", "rel_path", "path", "method", "language", "start_line", "end_line", "collection"]


def node_properties(rows: DataFrame) -> DataFrame:
    """key, properties map<string,string> of ``rows`` with any of the fields as columns: the key is the first that is neither null nor empty; nulls are no properties.

    Rows without a key are no nodes; other columns are ignored.
    """
    value = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    key = F.coalesce(*[F.nullif(value(c), F.lit("")) for c in KEY_FIELDS])
    kept = F.map_filter(F.create_map(*[x for c in PROPERTIES for x in (F.lit(c), value(c))]), lambda _, v: v.isNotNull())
    return rows.select(key.alias("key"), kept.alias("properties")).where(F.col("key").isNotNull())


def endpoints(chunks: DataFrame) -> DataFrame:
    """path, method of every route that a chunk declares; of several methods of a path the greatest that is not empty."""
    rows = chunks.select(F.explode(text.route_paths(F.col("content"), F.col("rel_path"))).alias("path"), text.http_verb(F.col("content")).alias("method"))
    return rows.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("method") != "", F.col("method"))), F.lit("")).alias("method"))


def service_edges(chunks: DataFrame, imports: DataFrame, deps: DataFrame, collections: DataFrame) -> DataFrame:
    """type, src, dst, token of the remaining families.

    IMPORTS (file to import, of ``imports``: collection, path, name), DECLARES_ENDPOINT and HTTP_CALLS (chunk to path),
    CONFIGURES (chunk of a configuration file to path), BUILD_DEPENDS (file to artifact, of ``deps``) and RESOLVES_TO (artifact to
    the collection it stands for).
    """
    none = F.lit("").alias("token")
    artifact = text.artifact_key(F.col("group"), F.col("artifact"), F.col("ecosystem"))
    matched = relations.match_dependencies(deps.withColumn("self", F.col("collection")).drop("collection"), collections)
    keys = deps.select("artifact", artifact.alias("key")).distinct()
    config = chunks.where(F.col("rel_path").rlike(text.CONFIG_FILE))
    parts = [
        imports.select(F.lit("IMPORTS").alias("type"), F.concat_ws(":", "collection", "path").alias("src"), text.import_key(F.col("collection"), F.col("name")).alias("dst"), none),
        chunks.select(F.lit("DECLARES_ENDPOINT"), "chunk_id", F.explode(text.route_paths(F.col("content"), F.col("rel_path"))), none),
        chunks.select(F.lit("HTTP_CALLS"), "chunk_id", F.explode(text.code_urls(F.col("content"))), none),
        config.select(F.lit("CONFIGURES"), "chunk_id", F.explode(text.config_urls(F.col("content"))["paths"]), none),
        deps.select(F.lit("BUILD_DEPENDS"), F.concat_ws(":", "collection", "path"), artifact, none),
        matched.join(keys, "artifact").select(F.lit("RESOLVES_TO"), "key", "collection", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def delete_files(graph_nodes: DataFrame, graph_edges: DataFrame, files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the files (collection, rel_path) and their chunks; symbols and endpoints stay, also those left alone."""
    gone = files.select(F.concat_ws(":", "collection", "rel_path").alias("key"))
    gone = gone.unionByName(chunks.join(files.select("collection", "rel_path").distinct(), ["collection", "rel_path"], "left_semi").select(F.col("chunk_id").alias("key"))).distinct()
    kept = graph_edges.join(gone.withColumnRenamed("key", "src"), "src", "left_anti").join(gone.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return graph_nodes.join(gone, "key", "left_anti"), kept.select(*graph_edges.columns)


def neighbor_keys(graph_edges: DataFrame) -> DataFrame:
    """chunk_id, keys: how many distinct symbols, paths and imports each chunk has of the families that ``graph_edges`` holds.

    Symbols it defines or calls, paths it declares, calls or configures, and what its file imports.
    """
    own = graph_edges.where(F.col("type").isin("DEFINES", "CALLS", "DECLARES_ENDPOINT", "HTTP_CALLS", "CONFIGURES")).select(F.col("src").alias("chunk_id"), "dst")
    imports = graph_edges.where(F.col("type") == "IMPORTS").select(F.col("src").alias("file"), "dst")
    shared = graph_edges.where(F.col("type") == "IN_FILE").select(F.col("src").alias("chunk_id"), F.col("dst").alias("file")).join(imports, "file").select("chunk_id", "dst")
    rows = own.unionByName(shared).distinct()
    return rows.groupBy("chunk_id").agg(F.count("*").alias("keys"))


def expand(graph_edges: DataFrame, seeds: DataFrame, hops: int, most: int | None = None, hubs: bool = False, types: tuple[str, ...] | None = None) -> DataFrame:
    """key, hop of what is within ``hops`` undirected steps of the seeds (key); the seeds are hop 0.

    Each step takes the edges at its frontier, in both directions, and keeps what is new; only frontiers are written, edges
    are read where they are. Walks
    take edges of any type, or of ``types``, and do not pass collections unless ``hubs``. With ``most`` the first by hop and key are kept, after ordering.
    """
    rows = graph_edges if types is None else graph_edges.where(F.col("type").isin(*types))
    rows = (rows if hubs else rows.where(~F.col("type").isin(*HUB_TYPES))).select("src", "dst")
    rows = cut(rows.distinct()) if hops > 1 else rows  # every step reads the edges once more
    reached = seeds.select("key").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, hops + 1):
        out = rows.join(frontier.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key"))
        into = rows.join(frontier.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"))
        step = out.union(into).distinct()
        frontier = cut(step.join(reached, "key", "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached.orderBy("hop", "key").limit(most) if most else reached


def callers(graph_edges: DataFrame, chunks: DataFrame, tokens: DataFrame, most: int = 10) -> DataFrame:
    """Per call token (and collection) the first ``most`` chunks with a CALLS edge of that token; symbol_type other where a chunk has none."""
    wanted = graph_edges.where(F.col("type") == "CALLS").join(tokens.select("token").distinct(), "token", "left_semi").select("token", F.col("src").alias("chunk_id")).distinct()
    rows = wanted.join(chunks.select("chunk_id", "collection", "rel_path", "start_line", F.coalesce("symbol_type", F.lit("other")).alias("symbol_type")).distinct(), "chunk_id")
    return top_per(rows, ["token", "collection"], [F.col("rel_path"), F.col("start_line"), F.col("chunk_id")], most)

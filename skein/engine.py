"""The tools of the retrieval service as methods that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text, vectors
from skein.operators import chunking, dependencies, graph, incremental, references, relations, search, state
from skein.sources.workspace import scan_workspace


class SkeinError(Exception):
    """An error with a kind (validation, not_found, conflict) and a code."""

    def __init__(self, kind: str, code: str, message: str):
        super().__init__(message)
        self.kind, self.code = kind, code

    def body(self) -> dict:
        return {"error": {"kind": self.kind, "code": self.code, "message": str(self), "metadata": {}}}


class Engine:
    """Search and analysis over chunks (with dense_vector) of any number of collections.

    ``embed`` gives the query vector of a text, ``embed_tokens`` its token vectors; they are the caller's models. Methods return plans; walks and call targets are evaluated in part on the way.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, embed: Callable[[str], list[float]] | None = None, dim: int = 64, embed_tokens: Callable[[str], list[list[float]]] | None = None):
        self.spark, self.chunks, self.embed, self.dim, self.embed_tokens = spark, chunks, embed, dim, embed_tokens

    # -- indexing

    def index_codebase(self, path: str, collection: str | None = None, ignore: list[str] | None = None) -> DataFrame:
        """The chunks of a workspace: definitions, else windows. They are stored by :meth:`upsert`, or by the chunk table of a stream."""
        name = collection or path.strip("/").split("/")[-1]
        files = scan_workspace(self.spark, path, ignore).withColumn("collection", F.lit(name))
        return chunking.chunk_files(files)

    def index_all(self, paths: dict[str, str], ignore: list[str] | None = None) -> DataFrame:
        """The chunks of several workspaces (collection to path)."""
        parts = [self.index_codebase(path, name, ignore) for name, path in sorted(paths.items())]
        if not parts:
            raise SkeinError("validation", "no_workspaces", "at least one workspace is needed")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def index_status(self, files: DataFrame, metadata: DataFrame, runs: DataFrame) -> DataFrame:
        """Per collection: the last run's status and how many records wait for the next run."""
        waiting = incremental.pending_records(files, metadata, runs).groupBy("collection").agg(F.count("*").alias("pending"))
        last = runs.groupBy("collection").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"), F.max("finished_at").alias("finished_at"))
        return last.join(waiting, "collection", "full").na.fill(0, ["pending"])

    # -- search

    def _query_vector(self, query: str) -> DataFrame:
        if self.embed is None:
            raise SkeinError("validation", "no_embedder", "a text query needs an embedder")
        return self.spark.createDataFrame([(self.embed(query),)], "query_vector array<double>")

    def _targets(self, primary: str | None, extra: list[str] | None) -> list[str]:
        return list(dict.fromkeys([primary or "codebase", *(extra or [])]))

    def search_codebase(self, query: str, top_k: int = 5, collection: str | None = None, collections: list[str] | None = None, language: str | None = None, min_score: float = 0.5, max_content_chars: int = 2000, sparse: bool = True, rerank: bool = False) -> DataFrame:
        """Hits of a text: dense and sparse lists per collection, fused; of several collections the fused lists are fused again.

        ``min_score`` holds in dense-only mode. With ``rerank`` the chunks of both lists are ordered by the late interaction of
        their token vectors (column multivector) with the query's instead of the first fusion.
        """
        self._check(top_k, 20)
        rows = self.chunks.where(F.col("collection").isin(self._targets(collection, collections)))
        rows = rows.where(F.col("language") == language) if language else rows
        q = F.broadcast(self._query_vector(query))  # one row
        scored = rows.where(vectors.usable(F.col("dense_vector"), self.dim)).crossJoin(q)
        dense = scored.select("collection", "chunk_id", F.round(vectors.cosine(F.col("dense_vector"), F.col("query_vector")), 6).alias("score"))
        lists = search.top_per(dense if sparse else dense.where(F.col("score") >= min_score), ["collection"], [F.desc("score"), F.col("chunk_id")], top_k * 5)
        both = lists.select("collection", "chunk_id", "rank")
        if sparse:
            asked = self.spark.createDataFrame([(0, query)], "query_id int, query_text string")
            found = search.sparse_topk(rows.select(F.struct("collection", "chunk_id").alias("key"), "content"), asked, top_k * 5, key="key")
            both = both.unionByName(found.select("key.collection", "key.chunk_id", "rank"))
        if rerank:
            both = self._reranked(rows, both, query, top_k)
        first = search.fused(both, ["collection"], ["chunk_id"], top_k, [F.col("chunk_id")], 2)
        last = search.fused(first.withColumn("rank", F.col("position")), [], ["collection", "chunk_id"], top_k, [F.desc("collection"), F.desc("chunk_id")])
        cut, was = text.truncated(F.col("content"), max_content_chars)
        detail = rows.select("collection", "chunk_id", "rel_path", "language", "start_line", "end_line", "symbol_name", cut.alias("content"), was.alias("truncated")).dropDuplicates(["collection", "chunk_id"])
        return last.join(detail, ["collection", "chunk_id"]).withColumn("fused", F.bround("fused", 4))

    def _reranked(self, rows: DataFrame, lists: DataFrame, query: str, k: int) -> DataFrame:
        """collection, chunk_id, rank of the listed chunks by late interaction; those without token vectors come last."""
        if self.embed_tokens is None or "multivector" not in rows.columns:
            raise SkeinError("validation", "no_multivectors", "a rerank needs token vectors of the chunks and of the query")
        asked = self.spark.createDataFrame([([[float(x) for x in v] for v in self.embed_tokens(query)],)], "query_tokens array<array<double>>")
        listed = lists.select("collection", "chunk_id").distinct().join(rows.select("collection", "chunk_id", "multivector").dropDuplicates(["collection", "chunk_id"]), ["collection", "chunk_id"])
        score = F.when(F.size("multivector") > 0, vectors.max_similarity(F.col("query_tokens"), F.col("multivector")))
        late = listed.crossJoin(F.broadcast(asked)).select("collection", "chunk_id", F.round(score, 6).alias("late"))  # one row
        return search.top_per(late, ["collection"], [F.desc_nulls_last("late"), F.col("chunk_id")], k).drop("late")

    def search_symbols(self, query: str, top_k: int = 10, **kwargs) -> DataFrame:
        return self.search_codebase(query, top_k, min_score=0.4, **kwargs).drop("content", "truncated")

    def get_chunk(self, chunk_id: str, collection: str | None = None) -> DataFrame:
        rows = self.chunks.where(F.col("chunk_id") == chunk_id)
        rows = rows.where(F.col("collection") == collection) if collection else rows
        return rows.drop("dense_vector").orderBy("collection").limit(1)

    def get_file_outline(self, rel_path: str, collection: str) -> DataFrame:
        rows = self.chunks.where((F.col("collection") == collection) & (F.col("rel_path") == rel_path))
        return rows.select("symbol_name", "symbol_type", "start_line", "end_line", "chunk_id").orderBy("start_line", "chunk_id")

    # -- collections

    def list_collections(self) -> DataFrame:
        return self.chunks.groupBy("collection").agg(F.count("*").alias("points")).orderBy("collection")

    def get_collection_summary(self, collection: str) -> DataFrame:
        return relations.collection_summary(self.chunks.where(F.col("collection") == collection))

    def get_collection_tree(self, collection: str) -> DataFrame:
        """folder, files of the folders down to the second level."""
        files = self.chunks.where(F.col("collection") == collection).select("rel_path").distinct()
        folders = files.select("rel_path", F.explode(text.folder_prefixes(F.col("rel_path"))).alias("folder")).where(F.col("folder").isNotNull())
        return folders.groupBy("folder").agg(F.count("*").alias("files"))

    def get_collection_dependencies(self, collection: str) -> DataFrame:
        """What the collection's manifests depend on, with the collection that each stands for (null if none) and how surely."""
        manifests = relations.merged_files(self.chunks.where((F.col("collection") == collection) & text.is_manifest(F.col("rel_path")))).withColumnRenamed("rel_path", "path")
        deps = dependencies.dependencies(manifests)
        matched = relations.match_dependencies(deps.withColumn("self", F.col("collection")).drop("collection"), self.chunks.select("collection"))
        return deps.join(matched.withColumnRenamed("collection", "stands_for"), "artifact", "left")

    # -- analysis

    def find_cross_references(
        self, symbol_name: str | None = None, collections: list[str] | None = None, query: str | None = None, member: str | None = None, receiver: str | None = None, top_k: int = 10, rerank: bool = False
    ) -> DataFrame:
        """References of a symbol, a text or a called member (of a receiver), merged, with reference_type; at least one of these is needed.

        A symbol gives its definitions and what a search for its import finds; a text what a search finds; a member its call sites.
        """
        if not (symbol_name or query or member):
            raise SkeinError("validation", "symbol_required", "a symbol, a query or a member is needed")
        names = collections or [r.collection for r in self.chunks.select("collection").distinct().orderBy("collection").collect()]  # collections are few
        rows = self.chunks.where(F.col("collection").isin(names))
        lookup = query or symbol_name or member
        parts = []

        def searched(words: str, kind: str) -> None:
            hits = self.search_codebase(words, top_k, names[0] if names else None, names[1:], min_score=0.3, rerank=rerank)
            parts.append(hits.select("collection", "chunk_id", F.col("fused").alias("score"), F.lit(kind).alias("match_type")))

        if query:
            searched(query, "semantic")
        if symbol_name:
            found = search.top_per(rows.where(F.col("symbol_name") == symbol_name).select("collection", "chunk_id", "rel_path", "start_line"), ["collection"], [F.col("rel_path"), F.col("start_line")], top_k)
            parts.append(found.select("collection", "chunk_id", F.lit(1.0).alias("score"), F.lit("exact_symbol").alias("match_type")))
            if self.embed:
                searched(f"import {symbol_name}", "import_search")
        if member or symbol_name:
            token = f"{receiver}.{member}" if receiver and member else member or symbol_name
            called = relations.find_callers(relations.calls(rows), self.spark.createDataFrame([(token,)], "symbol_name string"), top_k)
            parts.append(called.join(rows.select("point_id", "chunk_id"), "point_id").select("collection", "chunk_id", F.lit(1.0).alias("score"), F.lit("call_site").alias("match_type")))
        matches = parts[0]
        for p in parts[1:]:
            matches = matches.unionByName(p)
        detail = rows.select("collection", "chunk_id", "rel_path", "start_line", "content").dropDuplicates(["collection", "chunk_id"])
        kind = text.reference_type(F.coalesce("content", F.lit("")), F.lit(lookup), F.col("rel_path"))
        return references.merged(matches.join(detail, ["collection", "chunk_id"]).select(F.lit(lookup).alias("symbol_name"), "collection", "rel_path", "start_line", "match_type", "score", kind.alias("reference_type")))

    def map_service_dependencies(self, collections: list[str]) -> DataFrame:
        if len(set(collections)) < 2:
            raise SkeinError("validation", "too_few_collections", "at least two collections are needed")
        rows = self.chunks.where(F.col("collection").isin(collections))
        routes = rows.select("collection", F.explode(text.route_paths(F.col("content"), F.col("rel_path"))).alias("path"))
        called = rows.select("collection", F.explode(text.code_urls(F.col("content"))).alias("path"))
        configured = rows.where(F.col("rel_path").rlike(text.CONFIG_FILE)).select("collection", F.explode(text.config_urls(F.col("content"))["paths"]).alias("path"))
        edge = lambda df, kind: df.groupBy(F.col("caller_collection").alias("from"), F.col("endpoint_collection").alias("to")).agg(F.array_sort(F.collect_set(F.concat_ws(" → ", "caller", "endpoint"))).alias("paths")).withColumn("kind", F.lit(kind))
        http, config = edge(relations.matching_paths(called, routes), "http_call"), edge(relations.matching_paths(configured, routes), "service_config")
        manifests = relations.merged_files(rows.where(text.is_manifest(F.col("rel_path")))).withColumnRenamed("rel_path", "path")
        deps = dependencies.dependencies(manifests).withColumn("self", F.col("collection")).drop("collection")
        matched = relations.match_dependencies(deps.select("artifact", "group", "self"), rows.select("collection"))
        built = matched.join(deps.select("artifact", F.col("self").alias("from")).distinct(), "artifact").where(F.col("from") != F.col("collection"))
        built = built.groupBy("from", F.col("collection").alias("to")).agg(F.array_sort(F.collect_set("artifact")).alias("paths")).withColumn("kind", F.lit("build_dependency"))
        return http.unionByName(config).unionByName(built)

    def recommend_code(self, ids: list[int] | None = None, negative: list[int] | None = None, limit: int = 5, language: str | None = None, path_glob: str | None = None, texts: list[str] | None = None) -> DataFrame:
        """Chunks like the examples, which are chunks, texts or both."""
        if texts and self.embed is None:
            raise SkeinError("validation", "no_embedder", "text examples need an embedder")
        try:
            return search.recommend(self.chunks, ids or [], negative or [], limit, language, path_glob, self.dim, [[float(x) for x in self.embed(t)] for t in texts or []])
        except ValueError as e:
            raise SkeinError("validation", "examples", str(e)) from e

    def find_outlier_chunks(self, context: list[int], limit: int = 5, max_similarity: float = 0.55, language: str | None = None, path_glob: str | None = None) -> DataFrame:
        if not 0 <= max_similarity <= 1:
            raise SkeinError("validation", "similarity", "max_similarity must lie between 0 and 1")
        return search.outliers(self.chunks, context, limit, max_similarity, language, path_glob, self.dim)

    def expand_search_context(self, chunk_ids: list[str], hops: int = 1) -> DataFrame:
        """The chunks within ``hops`` (2 at most) of the given ones, with their payload; ids that are no chunks are skipped."""
        imports = relations.call_imports(self.chunks)
        resolved = relations.resolve_calls(relations.calls(self.chunks), relations.definitions(self.chunks), imports)
        seeds = self.spark.createDataFrame([(c,) for c in chunk_ids], "key string")
        manifests = relations.merged_files(self.chunks.where(text.is_manifest(F.col("rel_path")))).withColumnRenamed("rel_path", "path")
        others = graph.service_edges(self.chunks, imports.withColumnRenamed("rel_path", "path"), dependencies.dependencies(manifests), self.chunks.select("collection").distinct())
        near = graph.expand(graph.edges(self.chunks, resolved).union(others), seeds, min(max(hops, 1), 2))
        return near.join(self.chunks.drop("dense_vector"), F.col("key") == F.col("chunk_id")).drop("key")

    def get_health(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("ok").alias("status"))

    def upsert(self, incoming: DataFrame) -> Engine:
        """An engine over the chunks with ``incoming`` in place of those with the same collection and id."""
        return Engine(self.spark, state.upsert(self.chunks, incoming, ["collection", "chunk_id"]), self.embed, self.dim, self.embed_tokens)

    def _check(self, k: int, most: int) -> None:
        try:
            search.validate(k, most)
        except ValueError as e:
            raise SkeinError("validation", "top_k", str(e)) from e

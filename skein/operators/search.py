"""Ranked search: dense, sparse, hybrid, late interaction, fusion within and across collections.

Every ranking has a total order (score, then key). Query sets are DataFrames, so many queries are one plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import terms, text, vectors
from skein.session import cut


def validate(k: int, most: int = 30, collections: int | None = None) -> None:
    """Rejects what the tools' callers may not ask for."""
    if not 1 <= k <= most:
        raise ValueError(f"top_k must be between 1 and {most}")
    if collections is not None and collections < 2:
        raise ValueError("at least two collections are needed")


def top_per(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group with their rank; rows beyond are dropped before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def dense_topk(chunks: DataFrame, query: DataFrame, k: int, language: str | None = None, min_score: float | None = None, vector: str = "dense_vector", key: str = "point_id", dim: int = 64) -> DataFrame:
    """The ``k`` chunks whose vectors are nearest to the one row of ``query`` (query_vector) by cosine.

    Unusable vectors never match. The filter on language stands on the scan; ``min_score`` is inclusive.
    """
    rows = chunks.where(F.col("language") == language) if language else chunks
    rows = rows.where(vectors.usable(F.col(vector), dim)).crossJoin(F.broadcast(query.limit(1)))  # one row
    scored = rows.withColumn("score", F.round(vectors.cosine(F.col(vector), F.col("query_vector")), 6)).drop("query_vector", vector)
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), key).limit(k)


def _best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity) of the ``k`` greatest of every row, equal ones by the smaller id."""
    least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -np.inf)
    q, c = np.nonzero(sims >= least[:, None])
    order = np.lexsort((ids[c], -sims[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, q, side="left")
    top = np.arange(len(q)) - first < k
    return q[top], ids[c[top]], sims[q[top], c[top]]


def dense_topk_set(chunks: DataFrame, queries: DataFrame, k: int, key: str = "point_id", query_key: str = "query_id", vector: str = "dense_vector", dim: int = 64, block: int = 20_000) -> DataFrame:
    """query_key, key, score, rank: the ``k`` nearest of ``chunks`` for every row of ``queries`` (query_key, ``vector``), whole numbers as keys.

    Queries are taken in blocks of about ``block`` rows, so that what is sent to the tasks is bounded whatever their
    number; each block is one pass over the chunks, in matrix products, and a task puts out k rows a query. Score: cosine in double
    precision, 6 places; ties by the smaller key. Unusable vectors match nothing and ask nothing.
    """
    rows = chunks.where(F.col(key).isNotNull() & vectors.usable(F.col(vector), dim)).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    asked = queries.where(F.col(query_key).isNotNull() & vectors.usable(F.col(vector), dim)).select(F.col(query_key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("vector")).distinct()
    blocks = max(1, -(-asked.count() // block))
    schema = "query bigint, key bigint, score double"

    def unit(column) -> np.ndarray:
        x = column.flatten().to_numpy().reshape(-1, dim)
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    out = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toArrow().combine_chunks()  # about block rows
        if not part.num_rows:
            continue
        ids, q = part.column("query").to_numpy(), unit(part.column("vector").combine_chunks())

        def look(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in batches:
                if not b.num_rows:
                    continue
                x, keys = unit(b.column(1)), b.column(0).to_numpy()
                found = [best]
                for i in range(0, len(q), 512):
                    r, c, s = _best_of(np.round(q[i : i + 512] @ x.T, 6), keys, k)
                    found.append((r + i, c, s))
                r, c, s = map(np.concatenate, zip(*found))
                order = np.lexsort((c, -s, r))
                r, c, s = r[order], c[order], s[order]
                top = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
                best = (r[top], c[top], s[top])
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query", "key", "score"])

        found = rows.mapInArrow(look, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = chunks.sparkSession.createDataFrame([], schema)
    return top_per(out.withColumnsRenamed({"query": query_key, "key": key}), [query_key], [F.desc("score"), F.col(key)], k)


def postings(docs: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, token (a stem), weight of every stem of every document.

    Tokens are filtered, stemmed and counted, in this order; a document's length is how many it has.
    """
    rows = docs.where(F.length(content) > 0).select(*key, terms.stems_udf(text.kept_tokens(F.col(content))).alias("ts")).select(*key, F.size("ts").alias("length"), F.explode("ts").alias("token"))
    return rows.groupBy(*key, "token").agg(F.count("*").alias("count"), F.first("length").alias("length")).select(*key, "token", text.term_weight(F.col("count"), F.col("length")).alias("weight"))


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int, content: str = "content", key: str = "point_id", query_key: str = "query_id", query_text: str = "query_text", block: int = 500_000) -> DataFrame:
    """Per query the ``k`` documents with the greatest dot product of stem weights; only documents that share a stem.

    The queries' postings are taken in blocks of about ``block``, so that what is sent to the tasks is bounded whatever their
    number. A task scores its documents against a block and puts out, batch by batch, the k best of every query (and what is
    equal to the last of them): pairs of documents and queries are never shuffled. Scores have 6 places, ties go to the smaller key.
    """
    asked = cut(postings(queries, [query_key], query_text))
    kinds = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {docs.schema[key].dataType.simpleString()}, score double"
    rows = docs.where(F.length(content) > 0).select(key, terms.stems_udf(text.kept_tokens(F.col(content))).alias("ts"))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == n).toArrow().combine_chunks()  # about block rows
        if not part.num_rows:
            continue
        index = SparseQueries.of(part.column(query_key).combine_chunks(), part.column("token").combine_chunks(), part.column("weight").to_numpy())

        def look(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                doc, query, score = index.best(b.column(1), k)
                yield pa.RecordBatch.from_arrays([index.keys.take(pa.array(query)), b.column(0).take(pa.array(doc)), pa.array(score)], names=[query_key, key, "score"])

        found = rows.mapInArrow(look, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], kinds)
    return top_per(out, [query_key], [F.desc("score"), F.col(key)], k)


@dataclass(frozen=True)
class SparseQueries:
    """Postings of a block of queries: by token the queries that hold it and their weights."""

    keys: pa.Array
    tokens: pa.Array
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, keys: pa.Array, tokens: pa.Array, weight: np.ndarray) -> SparseQueries:
        keys, tokens = keys.dictionary_encode(), tokens.dictionary_encode()
        token = tokens.indices.to_numpy()
        order = np.argsort(token, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens.dictionary)))])
        return cls(keys.dictionary, tokens.dictionary, starts, keys.indices.to_numpy()[order], np.asarray(weight)[order])

    def best(self, documents: pa.Array, k: int, pairs: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, query, score) of the ``k`` best documents (arrays of stems) of every query and those equal to the last."""
        sizes = documents.value_lengths().fill_null(0).to_numpy()
        words = documents.flatten().dictionary_encode()
        known = pc.index_in(words.dictionary, value_set=self.tokens).fill_null(-1).to_numpy(zero_copy_only=False)
        token = known[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at, count = np.unique(doc[token >= 0] * len(self.tokens) + token[token >= 0], return_counts=True)
        doc, token = np.divmod(at, max(1, len(self.tokens)))
        own = count * (text.BM25_K + 1) / (count + text.BM25_K * (1 - text.BM25_B + text.BM25_B * sizes[doc] / text.AVERAGE_LENGTH))
        many = self.starts[token + 1] - self.starts[token]
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        total, begin = np.cumsum(many), 0
        while begin < len(doc):
            # as many postings as give about ``pairs`` pairs, to the end of a document
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + pairs, side="right"))
            end = int(np.searchsorted(doc, doc[min(max(end, begin + 1), len(doc)) - 1], side="right"))
            n = many[begin:end]
            spot = np.repeat(self.starts[token[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair = self.query[spot].astype(np.int64) * len(sizes) + np.repeat(doc[begin:end], n)
            both, where = np.unique(pair, return_inverse=True)
            score = np.round(np.bincount(where, weights=np.repeat(own[begin:end], n) * self.weight[spot], minlength=len(both)), 6)
            query, document = np.divmod(both, len(sizes))
            document, query, score = (np.concatenate([x, y]) for x, y in zip(held, (document, query, score)))
            order = np.lexsort((-score, query))
            document, query, score = document[order], query[order], score[order]
            first = np.searchsorted(query, query, side="left")
            last = np.minimum(first + k, np.searchsorted(query, query, side="right")) - 1
            good = score >= score[last]
            held = [document[good], query[good], score[good]]
            begin = end
        return held[0].astype(np.int64), held[1].astype(np.int64), held[2]


def best_hits(hits: DataFrame) -> DataFrame:
    """One score per query, scorer and chunk: the highest; null and NaN scores are none."""
    return hits.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("query_id", "scorer", "collection", "point_id", "chunk_id").agg(F.max("score").alias("score"))


def fused(lists: DataFrame, group: list[str], key: list[str], k: int, order: list[Column], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``rank`` from 1): per group the ``k`` keys with the greatest sum of 1 / (constant + rank)."""
    scored = lists.groupBy(*group, *key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"))
    return top_per(scored, group, [F.desc("fused"), *order], k, "position")


def hybrid_rrf(hits: DataFrame, k: int = 5, prefetch: int = 5, constant: int = 2) -> DataFrame:
    """Per query and collection: the first ``k * prefetch`` of the dense and of the sparse list, fused, cut to ``k``."""
    both = best_hits(hits).where(F.col("scorer").isin("dense", "sparse"))
    ranked = top_per(both, ["query_id", "collection", "scorer"], [F.desc("score"), F.col("chunk_id")], k * prefetch)
    return fused(ranked, ["query_id", "collection"], ["point_id", "chunk_id"], k, [F.col("chunk_id")], constant)


def rerank(hits: DataFrame, k: int = 5, prefetch: int = 100) -> DataFrame:
    """Per query and collection: the union of both prefetches, ordered by the multivector score; unscored chunks come last."""
    best = best_hits(hits)
    near = top_per(best.where(F.col("scorer").isin("dense", "sparse")), ["query_id", "collection", "scorer"], [F.desc("score"), F.col("chunk_id")], prefetch)
    near = near.select("query_id", "collection", "point_id", "chunk_id").distinct()
    late = best.where(F.col("scorer") == "multivector").select("query_id", "collection", "point_id", F.col("score").alias("late"))
    joined = near.join(late, ["query_id", "collection", "point_id"], "left")
    return top_per(joined, ["query_id", "collection"], [F.desc_nulls_last("late"), F.col("chunk_id")], k, "position")


def adaptive_rerank(hits: DataFrame, k: int = 5, gap: float = 0.02, constant: int = 2) -> DataFrame:
    """Hybrid results where the first leads the second by ``gap`` (skipped), reranked ones elsewhere; one plan, no driver branch."""
    probe = hybrid_rrf(hits, max(k, 2), 5, constant)
    lead = probe.groupBy("query_id", "collection").agg(
        ((F.count("*") >= 2) & (F.round(F.max(F.when(F.col("position") == 1, F.col("fused"))) - F.max(F.when(F.col("position") == 2, F.col("fused"))), 9) >= gap)).alias("skipped")
    )
    kept = probe.where(F.col("position") <= k).select("query_id", "collection", "point_id", "chunk_id", "position")
    kept = kept.join(lead.where("skipped"), ["query_id", "collection"])
    again = rerank(hits, k).select("query_id", "collection", "point_id", "chunk_id", "position").join(lead.where(~F.col("skipped")), ["query_id", "collection"])
    return kept.unionByName(again)


def rerank_counters(adaptive: DataFrame) -> DataFrame:
    """total, skipped, reranked over query and collection pairs."""
    pairs = adaptive.select("query_id", "collection", "skipped").distinct()
    return pairs.agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped")).alias("reranked"))


def cross_collection_rrf(hits: DataFrame, scorer: str = "dense", k: int = 10, constant: int = 60) -> DataFrame:
    """Per query one list over all collections: each collection's list fused; equal sums by collection, then chunk, descending.

    The emitted hit keeps its original score.
    """
    best = best_hits(hits).where(F.col("scorer") == scorer)
    ranked = top_per(best, ["query_id", "collection"], [F.desc("score"), F.col("chunk_id")], k)
    out = fused(ranked, ["query_id"], ["collection", "chunk_id"], k, [F.desc("collection"), F.desc("chunk_id")], constant)
    return out.join(ranked.select("query_id", "collection", "chunk_id", "point_id", "score"), ["query_id", "collection", "chunk_id"])


def fan_out(hits: DataFrame, scorer: str = "dense", k: int = 5, constant: int = 60) -> DataFrame:
    """Per query: of one collection its first ``k``, of several the fused ``k``."""
    best = best_hits(hits).where(F.col("scorer") == scorer)
    counts = best.groupBy("query_id").agg(F.count_distinct("collection").alias("n"))
    one = top_per(best.join(counts.where("n = 1"), "query_id", "left_semi"), ["query_id"], [F.desc("score"), F.col("chunk_id")], k, "position")
    many = cross_collection_rrf(hits.join(counts.where("n > 1"), "query_id", "left_semi"), scorer, k, constant)
    columns = ["query_id", "collection", "chunk_id", "score", "position"]
    return one.select(*columns).unionByName(many.select(*columns))


def multi_hop(hops: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Fusion of hops (query_id, hop, chunk_id, rank) by chunk; equal sums by chunk descending; the first occurrence's hop is kept."""
    scored = hops.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"), F.min(F.struct("hop", "rank")).alias("first"))
    return top_per(scored, ["query_id"], [F.desc("fused"), F.desc("chunk_id")], k, "position").select("query_id", "chunk_id", "fused", F.col("first.hop").alias("hop"), "position")


def recommend(
    chunks: DataFrame, positive: list[int], negative: list[int], k: int = 5, language: str | None = None, path_glob: str | None = None, dim: int = 64, more: list[list[float]] | None = None
) -> DataFrame:
    """The chunks nearest to twice the mean of the positive examples less the mean of the negative ones, without the examples.

    ``more``: vectors of further positive examples that are no chunks, such as texts.
    """
    more = more or []
    if not positive and not more or len(positive) + len(negative) + len(more) > 10:
        raise ValueError("one positive example at least and ten examples at most")
    rows = chunks.where(vectors.usable(F.col("dense_vector"), dim))
    given = chunks.sparkSession.createDataFrame([(-1, v) for v in more], "point_id bigint, dense_vector array<double>")

    def of(ids: list[int], extra: DataFrame | None) -> DataFrame:
        some = rows.where(F.col("point_id").isin(ids)).select(F.col("point_id").cast("bigint").alias("point_id"), F.col("dense_vector").cast("array<double>").alias("dense_vector"))
        return some if extra is None else some.unionByName(extra)

    mean = lambda ids, name: of(ids, given if more and name == "p" else None).agg(F.array(*[F.avg(F.col("dense_vector")[i].cast("double")) for i in range(dim)]).alias(name))
    query = mean(positive, "p")
    if negative:
        query = query.crossJoin(F.broadcast(mean(negative, "n"))).select(F.zip_with("p", "n", lambda p, n: 2 * p - n).alias("query_vector"))  # one row
    else:
        query = query.select(F.col("p").alias("query_vector"))
    others = rows.where(~F.col("point_id").isin(positive + negative))
    if path_glob:
        others = others.where(F.col("rel_path").rlike(text.glob_pattern(path_glob)))
    return dense_topk(others, query, k, language, dim=dim)


def outliers(chunks: DataFrame, context: list[int], k: int = 5, ceiling: float = 0.55, language: str | None = None, path_glob: str | None = None, dim: int = 64) -> DataFrame:
    """The chunks least like their context: those with the smallest greatest similarity to any of it (2k, 3k with a glob),
    ordered by cosine to its centroid, at most ``ceiling``."""
    rows = chunks.where(vectors.usable(F.col("dense_vector"), dim))
    given = rows.where(F.col("point_id").isin(context))
    context_rows = given.agg(F.collect_list("dense_vector").alias("context"), F.array(*[F.avg(F.col("dense_vector")[i].cast("double")) for i in range(dim)]).alias("centre"))
    others = rows.where(~F.col("point_id").isin(context))
    others = others.where(F.col("language") == language) if language else others
    others = others.where(F.col("rel_path").rlike(text.glob_pattern(path_glob))) if path_glob else others
    near = others.crossJoin(F.broadcast(context_rows))  # one row of at most the given context
    near = near.withColumn("nearest", F.round(F.array_max(F.transform("context", lambda c: vectors.cosine(F.col("dense_vector"), c))), 6))
    first = near.orderBy("nearest", "point_id").limit(k * (3 if path_glob else 2))
    scored = first.withColumn("score", F.round(vectors.cosine(F.col("dense_vector"), F.col("centre")), 6)).where(F.col("score") <= ceiling)
    return scored.drop("context", "centre", "dense_vector").orderBy("score", "point_id").limit(k)


def missing_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` (point_id) that no chunk has."""
    return ids.select("point_id").distinct().join(chunks.select("point_id"), "point_id", "left_anti")


def chunks_of_paths(chunks: DataFrame, paths: DataFrame, most: int | None = 500) -> DataFrame:
    """The chunks of a set of files (collection, rel_path) in path and line order; ``most`` in all, None for every one."""
    rows = chunks.join(paths.select("collection", "rel_path").distinct(), ["collection", "rel_path"], "left_semi").orderBy("collection", "rel_path", "start_line", "chunk_id")
    return rows.limit(most) if most is not None else rows


def context_sample(chunks: DataFrame, ids: list[int], path_glob: str | None = None, most: int = 200) -> DataFrame:
    """point_id, priority of the context: given ids first, then (without ids, or with a glob) others by chunk id, ``most`` in all."""
    given = chunks.where(F.col("point_id").isin(ids)).select("point_id", "chunk_id", F.lit(0).alias("priority"))
    rest = chunks.where(F.col("rel_path").rlike(text.glob_pattern(path_glob))) if path_glob else chunks.where(F.lit(not ids))
    rows = given.unionByName(rest.select("point_id", "chunk_id", F.lit(1).alias("priority"))).groupBy("point_id", "chunk_id").agg(F.min("priority").alias("priority"))
    return rows.orderBy("priority", "chunk_id", "point_id").limit(most).select("point_id", "priority")

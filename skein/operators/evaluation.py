"""Retrieval quality: metrics, comparisons, label drift, training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators.search import top_per


def query_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, mrr, ndcg of ``run`` (query_id, chunk_id, rank from 1) against ``qrels`` (query_id, chunk_id, grade > 0).

    Queries without labels have no metrics; labelled queries without results have zeros. Gains are linear.
    """
    top = run.where(F.col("rank") <= k)
    labels = qrels.where(F.col("grade") > 0)
    hits = top.join(labels, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal = top_per(labels, ["query_id"], [F.desc("grade"), F.col("chunk_id")], k, "place").groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("place") + 1)).alias("idcg"))
    sizes = labels.groupBy("query_id").agg(F.count("*").alias("labels"))
    rows = sizes.join(ideal, "query_id").join(hits, "query_id", "left")
    return rows.select(
        "query_id", F.round(F.coalesce(F.col("found") / F.col("labels"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame, group: list[str] | None = None) -> DataFrame:
    means = [F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg")]
    return metrics.groupBy(*(group or [])).agg(F.count("*").alias("queries"), *means)


def tagged(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query and tag; ``untagged`` where a query has none."""
    tags = queries.select("query_id", F.explode(F.when(F.size("tags") > 0, F.array_distinct("tags")).otherwise(F.array(F.lit("untagged")))).alias("tag"))
    return metrics.join(tags, "query_id")


def query_stats(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, retrieved, hits_in_top_k, labels, first_label_rank, top_hit_in_labels."""
    labels = qrels.where(F.col("grade") > 0).select("query_id", "chunk_id", F.lit(True).alias("labelled"))
    rows = run.join(labels, ["query_id", "chunk_id"], "left")
    hit = F.col("labelled").isNotNull()
    out = rows.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), F.count_if(hit & (F.col("rank") <= k)).alias("hits_in_top_k"), F.min(F.when(hit, F.col("rank"))).alias("first_label_rank"), F.coalesce(F.bool_or(hit & (F.col("rank") == 1)), F.lit(False)).alias("top_hit_in_labels"),
    )
    return out.join(labels.groupBy("query_id").agg(F.count("*").alias("labels")), "query_id", "left").na.fill(0, ["labels"])


def compare(current: DataFrame, baseline: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """metric, current, baseline, delta_percent, regression of two tables (metric, value). A base of 0 gives 0 or 100 per cent."""
    both = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), "metric")
    delta = F.when(F.col("baseline") == 0, F.when(F.col("current") == 0, 0.0).otherwise(100.0)).otherwise((F.col("current") - F.col("baseline")) / F.col("baseline") * 100)
    return both.withColumn("delta_percent", F.round(delta, 4)).withColumn("regression", F.col("delta_percent") < -tolerance)


def resolve_anchors(anchors: DataFrame, points: DataFrame) -> DataFrame:
    """anchor_id, chunk_id, method of label anchors (anchor_id, collection, rel_path, symbol, line) among live chunks.

    The first rung that holds: the chunk id of path and line lives (chunk_id); path and symbol, one chunk (content) or the
    nearest by line (nearest_line); the path, else the file name (basename); else unresolved. Ties by chunk id.
    """
    live = points.select("chunk_id", "collection", "rel_path", F.col("symbol_name").alias("live_symbol"), F.col("start_line").alias("live_line")).distinct()
    a = anchors.withColumn("legacy", text.chunk_id(F.col("rel_path"), F.col("line")))
    far = F.coalesce(F.abs(F.col("live_line") - F.col("line")), F.lit(0))
    pick = F.min(F.struct(far.alias("far"), "live_line", "chunk_id"))["chunk_id"]
    first = a.join(live.select(F.col("chunk_id").alias("legacy"), "collection"), ["collection", "legacy"], "left_semi").select("anchor_id", F.lit(1).alias("rung"), F.col("legacy").alias("chunk_id"), F.lit("chunk_id").alias("method"))
    by_symbol = a.where(F.length("symbol") > 0).join(live, (a["collection"] == live["collection"]) & (a["rel_path"] == live["rel_path"]) & (a["symbol"] == live["live_symbol"]))
    second = by_symbol.groupBy("anchor_id").agg(F.lit(2).alias("rung"), pick.alias("chunk_id"), F.when(F.count("*") == 1, "content").otherwise("nearest_line").alias("method"))
    third = a.join(live, ["collection", "rel_path"]).groupBy("anchor_id").agg(F.lit(3).alias("rung"), pick.alias("chunk_id"), F.lit("basename").alias("method"))
    names = live.withColumn("name", text.basename(F.col("rel_path"))).drop("rel_path")
    resolved = first.select("anchor_id").unionByName(second.select("anchor_id")).unionByName(third.select("anchor_id"))
    rest = a.join(resolved, "anchor_id", "left_anti")  # file names are hot keys: only what is still open is looked up by them
    fourth = rest.withColumn("name", text.basename(F.col("rel_path"))).join(names, ["collection", "name"]).groupBy("anchor_id").agg(F.lit(4).alias("rung"), pick.alias("chunk_id"), F.lit("basename").alias("method"))
    best = first.unionByName(second).unionByName(third).unionByName(fourth).groupBy("anchor_id").agg(F.min(F.struct("rung", "method", "chunk_id")).alias("best"))
    return anchors.select("anchor_id").join(best, "anchor_id", "left").select("anchor_id", "best.chunk_id", F.coalesce("best.method", F.lit("unresolved")).alias("method"))


def qrels_of(labels: DataFrame) -> DataFrame:
    """query_id, chunk_id, grade: of several labels of a chunk the greatest grade counts."""
    return labels.where(F.col("chunk_id").isNotNull()).groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))


def alias_labels(aliases: DataFrame) -> DataFrame:
    """Labels of aliases (query_id, collection, rel_path, start_line, grade) by the chunk id of collection/path and line."""
    path = F.when(F.startswith("rel_path", F.concat("collection", F.lit("/"))), F.col("rel_path")).otherwise(F.concat_ws("/", "collection", F.ltrim("rel_path", F.lit("/"))))
    return aliases.select("query_id", text.chunk_id(path, F.col("start_line")).alias("chunk_id"), "grade")


def hard_negatives(run: DataFrame, qrels: DataFrame, contents: DataFrame, most: int = 7) -> DataFrame:
    """query_id, chunk_id, position: hits that are no labels, in rank order, equal texts once, blank texts never."""
    rows = run.join(qrels.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti").join(contents.where(F.length(F.trim("content")) > 0), "chunk_id")
    once = rows.groupBy("query_id", F.xxhash64("content").alias("h"), "content").agg(F.min(F.struct("rank", "chunk_id")).alias("first")).select("query_id", "first.rank", "first.chunk_id")
    return top_per(once, ["query_id"], [F.col("rank"), F.col("chunk_id")], most, "position").select("query_id", "chunk_id", "position")


def best_positive(qrels: DataFrame, contents: DataFrame) -> DataFrame:
    """query_id, chunk_id, grade: the best-graded label that has a text; ties by chunk id."""
    rows = qrels.where(F.col("grade") > 0).join(contents.where(F.length(F.trim("content")) > 0).select("chunk_id").distinct(), "chunk_id", "left_semi")
    return top_per(rows, ["query_id"], [F.desc("grade"), F.col("chunk_id")], 1, "n").drop("n")


def holdout(queries: DataFrame, share: float = 0.15, seed: int = 42, ids: list[int] | None = None, tag: str | None = None) -> DataFrame:
    """query_id, part (train or holdout): by ids, by tag, or by a seeded hash of the id, the same on every run."""
    if ids is not None:
        held = F.col("query_id").isin(ids)
    elif tag is not None:
        held = F.coalesce(F.array_contains("tags", tag), F.lit(False))
    else:
        held = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "query_id"), 256), 1, 8), 16, 10).cast("double") / 2**32 < share
    return queries.select("query_id", F.when(held, "holdout").otherwise("train").alias("part"))


def percentiles(samples: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, p50, p95 (exact, interpolated)."""
    return samples.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95")
    )

"""The queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import abuse, distinctive, handwritten, mixing, neighbors, ranking, splitting, tokens, validity
from skein.operators.search import top_per
from skein.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that the model of their chunk makes more likely than the collection does; the exact conditions of a case then pick from these."""
    terms = distinctive.distinctive_terms(table(spark, d, "chunks"), min_count=3, min_records=2, max_records=6)
    return terms.where(F.col("score") > F.col("background")).select("point_id", "term")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, d, "chunks"))


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    """The five most distinctive terms of every chunk; scores that agree in 6 places are in the order of their terms."""
    terms = distinctive.distinctive_terms(table(spark, d, "chunks")).select("point_id", "term", F.round("score", 6).alias("score"))
    best = top_per(terms, ["point_id"], [F.desc("score"), F.col("term")], 5)
    return best.select("point_id", "term", "rank", "score")


def p1_indices(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_indices(table(spark, d, "embedded_chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.leading_everywhere(p2_ranking(spark, d))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.median_rank(table(spark, d, "search_hits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_files(spark, d).where(~F.col("valid")).select("record_id")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return validity.check_files(table(spark, d, "file_records"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.invalid_rates(p3_files(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(neighbors.nearest_vectors(table(spark, d, "embedded_chunks"), k=5, min_similarity=0.85), 0.85)


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest_vectors(table(spark, d, "embedded_chunks"), k=5)


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of p4_nearest against brute force for every id divisible by 100."""
    rows = table(spark, d, "embedded_chunks")
    return neighbors.recall(rows, neighbors.nearest_vectors(rows, k=5))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_files(spark, d).where("other").select("record_id")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(table(spark, d, "file_records"))


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many of the files found the grammars tell by themselves, and how many need marks, names, folders or layout; by kind."""
    rows = p5_files(spark, d).where("other")
    told = F.when(~F.col("by_grammar"), "marks").when(F.size("evidence") > 0, "both").otherwise("grammar")
    return rows.select(F.explode("kinds").alias("kind"), told.alias("told_by")).groupBy("kind", "told_by").agg(F.count("*").alias("records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where(F.col("piece") == 2).select("point_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p6_joined(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized chunk the digest of its pieces put together without their leads, and whether each fits."""
    rows = p6_pieces(spark, d).where("pieces > 1").select("point_id", F.struct("piece", F.expr("substring(content, lead + 1)").alias("text")).alias("p"), F.length("content").alias("size"))
    joined = rows.groupBy("point_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("text"), F.max("size").alias("size"))  # the pieces of one text
    return joined.select("point_id", F.md5("text").alias("digest"), (F.col("size") <= 2400).alias("fits"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: its documents with tokens, and whether the mixture keeps its limit and uses a document once in the list."""
    mixed, report = mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    used = mixed.groupBy("source").agg(F.max("copies").alias("most"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))
    both = report.join(F.broadcast(used), "source", "left")  # one row per target source
    keeps = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True))
    return both.select("source", "target_share", "max_repeats", "documents", keeps.alias("keeps_limit"), F.coalesce(F.col("rows") == F.col("ids"), F.lit(True)).alias("once"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_abuse(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(p10_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_top, p1_terms, p1_indices, p2_found, p2_ranking, p3_found, p3_files, p3_rates, p4_found, p4_nearest, p4_recall, p5_found, p5_files, p5_evidence, p6_found, p6_pieces, p6_joined, p8_ids, p9_report, p9_mixture, p9_limits, p10_found, p10_scores, p10_rates)}

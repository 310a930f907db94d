"""One ranking from several differently-scaled scores: median rank aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.session import cut, parts


def spread_rank(df: DataFrame, group: list[str], order: list[Column], name: str, dense_ties: bool = True) -> DataFrame:
    """``df`` with ``name``: the rank of each row in its group (equal keys share the smaller rank).

    A hot group does not land in one task: rows are range-partitioned on group *and* order, ranked within
    (partition, group), and shifted by the sizes of the group's earlier partitions, of which there are at most as many
    as partitions. Range bounds come from a sample and may differ when they are computed again, so the rows are
    written once with their partition number. With ``dense_ties`` false the order must be total.
    """
    ranged = cut(df.repartitionByRange(parts(df), *[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    local = F.rank() if dense_ties else F.row_number()
    ranked = ranged.withColumn("_local", local.over(W.partitionBy("_part", *group).orderBy(*order)))
    sizes = ranged.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return ranked.join(shifts, same).withColumn(name, F.col("_local") + F.col("_before")).select(*df.columns, name)


def weighted_median(pairs: Column) -> Column:
    """The weighted median of an array of (rank, weight) structs; halfway between two when the weight splits evenly."""
    ordered = F.array_sort(pairs)
    half = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["weight"]) / 2

    def at(reaches) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("rank"))

        def step(a, x):
            total = a["sum"] + x["weight"]
            return F.struct(total.alias("sum"), F.when(a["rank"].isNull() & reaches(total), x["rank"].cast("double")).otherwise(a["rank"]).alias("rank"))

        return F.aggregate(ordered, start, step)["rank"]

    return (at(lambda s: s >= half) + F.coalesce(at(lambda s: s > half), at(lambda s: s >= half))) / 2


def median_rank(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One ranking per query over the chunks of all its collections.

    ``hits``: query_id, collection, scorer, point_id, score (higher is better). A list is what one scorer returned for
    one query and collection; within it a point counts with its highest score; null and NaN scores are no scores.
    Each point has a rank in every list of its query and collection; where a list lacks it, one more than the list's
    length. Points are ordered by the weighted median of these ranks (``weights`` by scorer, 1 where absent or not
    positive), then by mean rank, point_id and collection. Only ranks are compared, so no scale dominates.

    Result: query_id, collection, point_id, median_rank, mean_rank, worst_rank, lists (how many lists the query and
    collection have), held (how many hold the point) and position (1 is best, unique per query). Repeated rows count once, a null query, collection or point is an ordinary value, no hits give no rows,
    other columns are ignored.
    """
    weight = F.lit(1.0)
    for scorer, w in (weights or {}).items():
        if w > 0:
            weight = F.when(F.col("scorer") == scorer, float(w)).otherwise(weight)
    keys = ["query_id", "collection", "scorer"]
    scored = hits.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*keys, "point_id").agg(F.max("score").alias("score"))
    ranks = spread_rank(scored, keys, [F.col("score").desc()], "rank")
    lists = scored.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("query_id", "collection")
    lists = lists.agg(F.collect_list(F.struct("scorer", "size", weight.alias("weight"))).alias("all"))
    points = ranks.groupBy("query_id", "collection", "point_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("scorer", F.lit("\0")).alias("s"), "rank"))).alias("got"))
    lists = lists.select(F.col("query_id").alias("_q"), F.col("collection").alias("_c"), "all")
    both = points.join(lists, F.col("query_id").eqNullSafe(F.col("_q")) & F.col("collection").eqNullSafe(F.col("_c")))
    pairs = F.transform("all", lambda x: F.struct(F.coalesce(F.try_element_at("got", F.coalesce(x["scorer"], F.lit("\0"))), x["size"] + 1).cast("bigint").alias("rank"), x["weight"].alias("weight")))
    pairs = both.select("query_id", "collection", "point_id", F.size("got").alias("held"), pairs.alias("pairs"))
    total = F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["rank"] * x["weight"])
    weight_sum = F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["weight"])
    out = pairs.select(
        "query_id", "collection", "point_id", weighted_median(F.col("pairs")).alias("median_rank"), (total / weight_sum).alias("mean_rank"),
        F.array_max(F.transform("pairs", lambda x: x["rank"])).alias("worst_rank"), F.size("pairs").alias("lists"), "held",
    )
    order = [F.col("median_rank"), F.col("mean_rank"), F.col("point_id"), F.col("collection")]
    return spread_rank(out, ["query_id"], order, "position", dense_ties=False)


def leading_everywhere(ranking: DataFrame, first: int = 3, at_least: int = 2) -> DataFrame:
    """query_id, point_id of the points at the head of a ranking that are among the ``first`` in every list, where there are ``at_least`` lists.

    The head are the positions up to the last with a median rank of ``first`` or better: no other point can be among the first everywhere.
    """
    head = ranking.where(F.col("median_rank") <= first).groupBy("query_id").agg(F.max("position").alias("_head"))
    near = ranking.join(head.withColumnRenamed("query_id", "_q"), F.col("query_id").eqNullSafe(F.col("_q"))).where(F.col("position") <= F.col("_head"))
    near = near.where(F.col("worst_rank") <= first)
    return near.where((F.col("lists") >= at_least) & (F.col("held") == F.col("lists"))).select("query_id", "point_id").distinct()

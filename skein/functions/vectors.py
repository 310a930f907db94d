"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    na, nb = norm(a), norm(b)
    good = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(good, dot(a, b) / (na * nb)).otherwise(0.0)


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components that are not all zero."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def max_similarity(query: Column, doc: Column) -> Column:
    """Late interaction: per query vector the greatest dot product with a document vector, summed."""
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(doc, lambda d: dot(q, d))))


def slices(v: Column, width: int) -> Column:
    """A vector as consecutive vectors of ``width``."""
    return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(width)), lambda i: F.slice(v, i, width))


def centroids(vectors: DataFrame, group: list[str], vector: str, dim: int) -> DataFrame:
    """``group``, centroid array<double>, members: the mean per component; partial sums, no explode, nothing collected."""
    sums = [F.avg(F.col(vector)[i].cast("double")).alias(f"c{i}") for i in range(dim)]
    return vectors.groupBy(*group).agg(F.count("*").alias("members"), *sums).select(*group, F.array(*[f"c{i}" for i in range(dim)]).alias("centroid"), "members")

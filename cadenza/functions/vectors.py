"""Vectors as arrays: dots, norms, cosines, and means of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import bound

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def unit(a: Column) -> Column:
    return bound(a, lambda v: bound(norm(v) + EPSILON, lambda size: F.transform(v, lambda x: x.cast("double") / size)))


def rounded(a: Column, digits: int) -> Column:
    """Each component as a double, rounded; one below zero that rounds to zero keeps its sign, as in IEEE arithmetic, and doesn't turn into 0.0."""

    def one(x: Column) -> Column:
        r = F.round(x, digits)
        return F.when(r == 0, x * 0.0).otherwise(r)

    return F.transform(a, lambda x: one(x.cast("double")))


def sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, n, total (element-wise sum): positions are summed with partial aggregation, then put in order."""
    spread = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    each = spread.groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(*keys, "n", F.transform("p", lambda s: s["x"]).alias("total"))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, n, centroid: the mean, scaled to unit length."""
    return sums(df, keys, vector).select(*keys, "n", unit(F.transform("total", lambda x: x / F.col("n"))).alias("centroid"))


def leave_one_out(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Each row with `loo`: its cosine to the centroid of all others of its group; null where it is alone."""
    total = sums(df, keys, vector)
    both = df.join(total, keys)
    rest = F.zip_with("total", vector, lambda t, x: t - x.cast("double"))
    near = bound(rest, lambda r: dot(r, F.col(vector)) / ((norm(r) + EPSILON) * (norm(F.col(vector)) + EPSILON)))
    return both.withColumn("loo", F.when(F.col("n") > 1, near)).drop("total", "n")


def self_similarity(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, self_similarity: the median of `loo`, 1 for groups of one."""
    return leave_one_out(df, keys, vector).groupBy(*keys).agg(F.coalesce(F.median("loo"), F.lit(1.0)).alias("self_similarity"))

"""Running sums over ordered groups of any size.

Rows are range-partitioned by (keys, order), so a group lies in neighbouring partitions, none of which is larger than others.
A partition's total for a group is one row; running sums of those say where each partition begins, and rows are summed up inside
their partition only.  Partitions that begin beyond a limit are never looked into.  Tables out of less than `SMALL` bytes fit any task
and take a plain window; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.files import filesystem, scratch

SMALL = 128 << 20


def is_large(df: DataFrame) -> bool:
    """Whether a group of df may be too large for a task, by the bytes of all that it reads, without running it.

    What Spark estimates for joins grows with their number, so its estimates of files count alone; of checkpoints, their files do.  Rows
    that came from the driver are few; sources of unknown size count as large.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            file = leaf.rdd().getCheckpointFile()
            if file.isDefined():
                fs, at = filesystem(spark, file.get())
                total += fs.getContentSummary(at(file.get())).getLength()
        else:
            total += int(str(leaf.stats().sizeInBytes()))
    return total > SMALL


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df cut into sorted ranges, written once so that all that follows sees the same ones; adds __part and __row, which count up in that order."""
    scratch(df.sparkSession)
    by = [*[F.col(k) for k in keys], *order]
    x = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    return x.withColumn("__part", F.shiftrightunsigned("__row", 33))


def starts(parts: DataFrame, keys: list[str], total: str, name: str) -> DataFrame:
    """The sum of a group's totals in the partitions before each (keys, __part, total); a row for each group and partition comes together."""
    w = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(total).over(w), F.lit(0).cast("double")))


def beside(x: DataFrame, small: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """x with columns of small by (keys, __part); null keys are equal."""
    there = small.select(*[F.col(k).alias(f"__there{i}") for i, k in enumerate(keys)], F.col("__part").alias("__there"), *columns)
    on = F.col("__part") == F.col("__there")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__there{i}"))
    return x.join(there, on).drop("__there", *[f"__there{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: list[Column], cost: str, name: str, limit: Column | None = None, large: bool | None = None) -> DataFrame:
    """Adds the sum of the costs before each row of its group; with `limit`, a condition on it that stays false once it is, only rows that meet it.

    The order has to be total; null costs count nothing; without keys all rows are one group.
    """
    if not (is_large(df) if large is None else large):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        out = df.withColumn(name, F.coalesce(F.sum(cost).over(w), F.lit(0).cast("double")))
        return out if limit is None else out.where(limit)
    x = ranged(df, keys, order)
    parts = x.groupBy(*keys, "__part").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("__total"))
    begin = starts(parts, keys, "__total", name)
    begin = (begin if limit is None else begin.where(limit)).withColumnRenamed(name, "__begin")
    x = beside(x, begin, keys, "__begin")
    w = W.partitionBy(*keys, "__part").orderBy("__row").rowsBetween(W.unboundedPreceding, -1)
    out = x.withColumn(name, F.col("__begin") + F.coalesce(F.sum(cost).over(w), F.lit(0).cast("double"))).drop("__begin", "__part", "__row")
    return out if limit is None else out.where(limit)


def in_turn(df: DataFrame, keys: list[str], order: list[Column], arrive: str, took: str, large: bool | None = None) -> DataFrame:
    """Adds `finished` of jobs that are done one at a time in order: with T the running sum of times taken, T plus the largest (arrival - T before) so far.

    Totals of (time taken, largest) are put together as they are inside: those of the part before, then those after it shifted by its time.
    """
    late = F.col(arrive) - (F.col("__t") - F.col(took))
    if not (is_large(df) if large is None else large):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn("__t", F.sum(took).over(w)).withColumn("finished", F.col("__t") + F.max(late).over(w)).drop("__t")
    x = ranged(df, keys, order)
    w = W.partitionBy(*keys, "__part").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("__t", F.sum(took).over(w)).withColumn("__late", late)
    parts = x.groupBy(*keys, "__part").agg(F.sum(took).alias("__total"), F.max("__late").alias("__most"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__begin", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    parts = parts.withColumn("__above", F.max(F.col("__most") - F.col("__begin")).over(before))
    x = beside(x, parts, keys, "__begin", "__above")
    most = F.greatest(F.max("__late").over(w) - F.col("__begin"), F.col("__above"))  # a missing one is ignored
    return x.withColumn("finished", F.col("__begin") + F.col("__t") + most).drop("__t", "__late", "__begin", "__above", "__part", "__row")

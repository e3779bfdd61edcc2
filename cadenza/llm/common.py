"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def ascii_strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local session may fall back to a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="cadenza-checkpoints-")
    spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once and goes on from there; a lost executor costs a reread only."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    cuts = _CUTS.get()
    if cuts is not None:
        cuts.append(out._jdf.logicalPlan().rdd().getCheckpointFile().get())
    return out


_CUTS: ContextVar[list[str] | None] = ContextVar("cuts", default=None)


@contextmanager
def cuts_removed(spark: SparkSession) -> Iterator[None]:
    """Deletes what `cut` has written inside, at the end of the block; results that are still wanted must be written by then."""
    before = _CUTS.set([])
    try:
        yield
    finally:
        for file in _CUTS.get():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _CUTS.reset(before)


def globally_indexed(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Adds the row's 0-based place in the order of `keys`, without one task seeing all rows.

    Rows are range-partitioned and sorted, numbered inside their partition, and the partitions' sizes are summed
    up; only those sizes, one row per partition, meet in one place.  Rows with equal keys are told apart by a hash of
    their columns, so many of them (null keys, say) don't all fall to one partition; rows equal in all take any order.
    """
    plain = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = [*keys, F.xxhash64(*plain)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    out = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, place).drop("__part", "__start", "__at")


def plain_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, cast-free; extra columns of the caller, however named, go no further."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

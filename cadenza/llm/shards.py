"""Proportional stratified interleaving: every shard matches the mixture of sources.

Rows of each source are shuffled by a seeded hash and ranked; rank r of n becomes the fraction (r + 1/2) / n; all
rows are sorted by that fraction and cut into shards of equal counts.  Both ranks come from range
partitioning with summed partition sizes, so neither a hot source nor the whole table meets in one task.

The law is `rows`: shard counts differ by at most one.

Results in special cases
------------------------
* null text: size 16 and the checksum of no bytes; null source: a source of its own; null doc_id: an ordinary row;
* repeated rows: each row has its own place; equal texts may go to different shards, as counts decide here;
* ties of the fraction between sources: ordered by a seeded hash of the source, then by source;
* empty table: empty result; fewer rows than shards: the last shards stay empty;
* long texts: only their size and checksum move; further columns, however named, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS, SEED, OVERHEAD = 40, 20240229, 16


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot (place in the shard), position (place in the whole)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = common.cut(rows.withColumn("__shuffle", F.xxhash64("doc_id", "text_crc32", F.lit(seed))))  # the text is read once
    of_source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
    ranked = common.globally_indexed(rows, [F.col("source"), F.col("__shuffle"), F.col("doc_id")], "__place")
    # where a source begins in the order by source: the rows of all smaller sources.  A row per source and partition at most
    begins = ranked.groupBy("source").agg(F.min("__place").alias("__begin"))
    known = of_source.join(begins, of_source["source"].eqNullSafe(begins["source"])).select(of_source["source"].alias("__source"), "__n", "__begin")
    ranked = ranked.join(known, F.col("source").eqNullSafe(F.col("__source")))
    fraction = (F.col("__place") - F.col("__begin") + 0.5) / F.col("__n")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", fraction.alias("__fraction"), F.xxhash64("source", F.lit(seed)).alias("__tie"))
    placed = common.globally_indexed(ranked, [F.col("__fraction"), F.col("__tie"), F.col("source")], "position")
    total = rows.count()
    # shard k takes places k * total / shards and on; its number is the largest k whose begin isn't beyond the place
    k = F.expr(f"((position + 1) * {shards} - 1) div {max(total, 1)}")
    placed = placed.withColumn("shard", k.cast("int"))
    begin = F.expr(f"(shard * {total}L) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - begin).cast("long").alias("slot"), "position")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "position")

"""The stages of the corpus pipeline; each works on all documents that the one before has kept.

Results in special cases: those of the operators.  Null and empty texts are documents and are scored, kept or packed as such;
rows without doc_id are never near copies; of rows that repeat wholly, one stays after the near-copy stage; columns beyond
doc_id and text, however named, are carried unchanged (n_chars follows the text); empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, line_dedup, packing, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, common.plain_columns(common.table(spark, sf_dir, "labels"), ["doc_id", "quality"]))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat across them; n_chars follows the text."""
    out = line_dedup.deduplicate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.clean(docs, common.plain_columns(common.table(spark, sf_dir, "benchmark"), ["item_id", "text"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_copies", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next; what a stage has written and cut goes once the next is through.

    The last stage packs pieces that it has checkpointed, so its result doesn't need the folder any more.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        for k, (_, stage) in enumerate(STAGES):
            if k + 1 == len(STAGES):
                docs = stage(spark, docs, sf_dir)
            else:
                with common.cuts_removed(spark):
                    stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
                docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
    finally:
        files.delete(path, True)
    return docs

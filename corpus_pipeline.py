"""The corpus pipeline: stages applied one after the other to the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import stages

STAGES = stages.STAGES

#: Training, hashing and tokenizing have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    return stages.run(spark, sf_dir)

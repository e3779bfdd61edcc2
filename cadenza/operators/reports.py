"""Choice of benchmark cases per speaker, and summaries per engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text, vectors

# Seconds a reference may last and had better last, words of a target, targets, and rows held out.
REFERENCE, BEST, TARGET, TARGETS, HELD_OUT = (8.0, 14.0), 10.5, (12, 30), 2, 20


def cases(utterances: DataFrame) -> DataFrame:
    """Utterances (speaker, id, text, duration) with their `role`: reference, target, holdout or none.

    The reference is the one nearest to the best length; targets are the first others of a fit number of words, held out are the
    first of the rest, in the order of ids.  Speakers without a reference have no cases.
    """
    fits = F.col("duration").between(*REFERENCE)
    chosen = utterances.where(fits).groupBy("speaker").agg(F.min(F.struct(F.abs(F.col("duration") - BEST).alias("off"), "id"))["id"].alias("__reference"))
    x = utterances.join(chosen, "speaker").withColumn("is_ref", F.col("id") == F.col("__reference"))
    # what a text holds, not what it says: words as they stand
    n = F.size(text.words(text.squash(F.coalesce("text", F.lit("")))))
    x = x.withColumn("__fit", ~F.col("is_ref") & n.between(*TARGET))
    x = x.withColumn("__n", F.row_number().over(W.partitionBy("speaker", "__fit").orderBy("id"))).withColumn("is_target", F.col("__fit") & (F.col("__n") <= TARGETS))
    rest = ~F.col("is_ref") & ~F.col("is_target")
    x = x.withColumn("__r", F.sum(F.when(rest, 1).otherwise(0)).over(W.partitionBy("speaker").orderBy("id")))
    role = F.when(F.col("is_ref"), "reference").when(F.col("is_target"), "target").when(rest & (F.col("__r") <= HELD_OUT), "holdout").otherwise("none")
    return x.select("speaker", "id", role.alias("role"))


def held_out_centroids(utterances: DataFrame, embeddings: DataFrame) -> DataFrame:
    """speaker, n, centroid of the rows held out (embeddings: id, emb)."""
    out = cases(utterances).where("role = 'holdout'").join(embeddings.select("id", "emb"), "id")
    return vectors.centroids(out, ["speaker"], "emb")


def by_engine(rows: DataFrame) -> DataFrame:
    """engine, n, means of wer, cer and sim, the least sim, and the median real-time factor."""
    return rows.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"), F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.avg("sim").alias("sim"), F.min("sim").alias("min_sim"), F.median("rtf").alias("rtf")
    )

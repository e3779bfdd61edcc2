"""Sinks: manifests, and delivery of whole verified batches behind the consent gate."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import filesystem
from ..operators import consent, gates

# The formats that may be delivered, and the sentence every delivered file carries.
FORMATS = ("wav", "flac", "mp3", "m4a", "ogg")
DISCLOSURE = "This audio is synthetic speech."
GENERATOR, WATERMARK, STAMP = "cadenza", "16-bit payload", "yyyy-MM-dd'T'HH:mm:ss'Z'"


def checked_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return name


def disclosure_tags(voice: Column, speaker: Column, kind: Column, engine: Column) -> Column:
    """The tags of a delivered file, by the kind of its consent."""
    basis = F.when(kind == "spoken", "spoken consent").otherwise("consent attested by the operator")
    said = F.concat(F.lit(DISCLOSURE + " Voice of "), speaker, F.lit(", by "), basis, F.lit("."))
    pairs = {
        "comment": said, "description": F.lit(DISCLOSURE), "encoded_by": F.lit(GENERATOR), "ai_generated": F.lit("true"), "synthetic_voice": speaker,
        "cadenza_voice": voice, "cadenza_engine": engine, "cadenza_consent": kind, "cadenza_watermark": F.lit(WATERMARK),
    }
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def tags_ok(tags: Column) -> Column:
    """The sentence stands in the comment or the description; not every container keeps both."""
    return F.coalesce(F.concat_ws(" ", tags["comment"], tags["description"]).contains(DISCLOSURE), F.lit(False))


def manifest(takes: DataFrame, keys: list[str], fields: list[str], order: str, created: Column | None = None) -> DataFrame:
    """keys, n, json: one document per render, attempts in order; with `created`, also by what and when it was made."""
    each = takes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("attempts"))
    head = [] if created is None else [F.lit(GENERATOR).alias("generator"), F.date_format(created, STAMP).alias("created")]
    return each.select(*keys, F.size("attempts").alias("n"), F.to_json(F.struct(*head, *keys, "attempts")).alias("json"))


def write_documents(documents: DataFrame, target: str) -> None:
    """JSON documents (json) as lines below `target`, staged and renamed, so that no reader sees half of them."""
    spark = documents.sparkSession
    fs, path = filesystem(spark, target)
    stage = f"{target}.part-{uuid.uuid4().hex}"
    try:
        documents.select(F.col("json").alias("value")).write.text(stage)
        old = f"{stage}.old"
        if fs.exists(path(target)) and not fs.rename(path(target), path(old)):
            raise OSError(f"could not put {target} aside")
        if not fs.rename(path(stage), path(target)):
            fs.rename(path(old), path(target))
            raise OSError(f"could not rename to {target}")
        fs.delete(path(old), True)
    finally:
        fs.delete(path(stage), True)


def write_bank(references: DataFrame, path: str) -> None:
    """Rewrites the references of the voices given, a partition each; those of other voices stay."""
    references.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("voice").parquet(path)


def deliver(batch: DataFrame, ledger: Callable[[], DataFrame], target: str) -> None:
    """Writes a batch (voice, probability, payload, tags, true_peak, ...) all or nothing.

    The batch is staged; every staged row is verified; the ledger is read again; only then is the stage renamed to `target`, which
    must not exist.  Rows that name the grant they were made under (kind, created) are refused if it is another one by now.
    Whatever fails removes the stage.
    """
    spark: SparkSession = batch.sparkSession
    stage = f"{target}.part-{uuid.uuid4().hex}"
    fs, path = filesystem(spark, target)
    if fs.exists(path(target)):
        raise FileExistsError(target)
    try:
        batch.write.parquet(stage)
        rows = spark.read.parquet(stage)
        bad = rows.withColumn("why", gates.delivery_reason(F.col("probability"), F.col("payload"), tags_ok(F.col("tags")), F.col("true_peak"))).where("why <> ''")
        if (first := bad.select("why").first()) is not None:
            raise ValueError(f"not delivered: {first['why']}")
        now = ledger()
        usable = consent.current(now).where("usable").select("voice")
        if rows.where("voice IS NULL").limit(1).count() or rows.join(usable, "voice", "left_anti").limit(1).count():
            raise PermissionError("not delivered: consent is missing or no longer usable")
        if {"kind", "created"} <= set(rows.columns) and (other := consent.unchanged(rows, now).where("problem <> ''").select("problem").first()) is not None:
            raise PermissionError(f"not delivered: {other['problem']}")
        if not fs.rename(path(stage), path(target)):
            raise OSError(f"could not rename to {target}")
    finally:
        if fs.exists(path(stage)):
            fs.delete(path(stage), True)


class Refused(ValueError):
    """A batch of a stream that may not be delivered."""


def deliver_batch(batch: DataFrame, number: int, ledger: Callable[[], DataFrame], folder: str, keep_on: bool = False) -> str:
    """Delivers a numbered batch once, as `folder/batch-<number>`: delivered, refused, or done before.

    The name is the record of the commit: a batch that is played again after a crash finds it, and is not written twice; what an
    attempt before the rename has left is removed.  A refusal is put on record as well, in `folder/_refused`, so a batch that
    was refused stays so when it is played again, whatever the ledger says by then.
    """
    spark = batch.sparkSession
    fs, at = filesystem(spark, folder)
    name, refused = f"batch-{number:010d}", f"{folder}/_refused/{number:010d}"
    if fs.exists(at(f"{folder}/{name}")):
        return "done before"
    if fs.exists(at(refused)):
        if not keep_on:
            raise Refused(f"batch {number} was refused before")
        return "done before"
    if fs.exists(at(folder)):
        for f in fs.listStatus(at(folder)):
            if f.getPath().getName().startswith(f"{name}.part-"):
                fs.delete(f.getPath(), True)
    try:
        deliver(batch, ledger, f"{folder}/{name}")
    except (ValueError, PermissionError) as why:
        write_documents(spark.createDataFrame([(str(why),)], "json string"), refused)
        if not keep_on:
            raise Refused(str(why)) from why
        return "refused"
    return "delivered"


def deliver_stream(stream: DataFrame, ledger: Callable[[], DataFrame], folder: str, checkpoint: str, keep_on: bool = False):
    """A stream writer, to be started, that delivers each of its batches once or not at all.  keep_on: a refused batch doesn't stop the stream."""
    return stream.writeStream.foreachBatch(lambda batch, number: deliver_batch(batch, number, ledger, folder, keep_on) and None).option("checkpointLocation", checkpoint)

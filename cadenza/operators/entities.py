"""Voices as rows: names, creation, deletion and look-ups; outputs: where they may go and how they are named; models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars
from .gates import first_failing

# Endings of audio outputs, and what a manifest's name ends in.
OUTPUTS = ("wav", "mp3", "m4a", "ogg", "flac")
MANIFEST = ".cadenza.json"


def exists(asked: DataFrame, voices: DataFrame) -> DataFrame:
    """Asked names (voice) with `exists`."""
    there = voices.select("voice").distinct().withColumn("__there", F.lit(True))
    return asked.join(there, "voice", "left").withColumn("exists", F.coalesce("__there", F.lit(False))).drop("__there")


def created(asked: DataFrame, voices: DataFrame) -> DataFrame:
    """New voices out of asked (voice, speaker, language, now), each with a `problem`, which is empty where it may be added.

    Of a name asked for several times, the first by time, then by speaker, is new.
    """
    first = F.row_number().over(W.partitionBy("voice").orderBy("now", "speaker"))
    x = exists(asked, voices).withColumn("__n", first)
    problem = first_failing((~scalars.name_ok(F.col("voice")), "bad name"), (F.col("exists") | (F.col("__n") > 1), "already exists"))
    return x.select("voice", "speaker", F.coalesce("language", F.lit("en")).alias("language"), F.col("now").alias("created"), problem.alias("problem"))


def deleted(tables: dict[str, DataFrame], voices: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table keyed by voice (references, sources, consent, ...) once the given voices are gone from all."""
    return {name: rows.join(voices.select("voice"), "voice", "left_anti") for name, rows in tables.items()}


def reference(references: DataFrame, voice: str, name: str) -> DataFrame:
    """The one row of a reference; a KeyError if there is none."""
    row = references.where((F.col("voice") == voice) & (F.col("id") == name))
    if not row.limit(1).count():
        raise KeyError(f"voice {voice!r} has no reference {name!r}")
    return row


def reference_path(root: str, voice: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), voice, path)


def resolved(path: Column, root: str) -> Column:
    """An absolute path without `.`, `..` and doubled slashes; relative ones lie below root."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    steps = F.filter(F.split(full, "/"), lambda s: ~s.isin("", "."))
    up = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))


def below(path: Column, folder: str) -> Column:
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def manifest_name(output: Column) -> Column:
    """Beside the audio, under a name that no other document has."""
    return F.concat(F.regexp_replace(output, r"(?<=[^/])\.[^./]*$", ""), F.lit(MANIFEST))


def default_output(folder: str, voice: Column, now: Column, ending: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), voice, F.lit("-"), scalars.stamp(now), F.lit("." + ending))


def guarded(outputs: DataFrame, protected: list[str], root: str) -> DataFrame:
    """Outputs (path) with `path` resolved and a `problem` where they would lie in a protected folder."""
    at = resolved(F.col("path"), root)
    bad = F.lit(False)
    for folder in protected:
        bad = bad | below(F.col("path"), folder)
    return outputs.withColumn("path", at).withColumn("problem", first_failing((bad, "protected folder")))


def agent_outputs(outputs: DataFrame, root: str, existing: DataFrame) -> DataFrame:
    """Outputs (path) of automated callers: below root alone, of a known ending, and neither the audio nor its manifest there already (existing: path)."""
    at = outputs.withColumn("path", resolved(F.col("path"), root)).withColumn("__manifest", manifest_name(F.col("path")))
    files = existing.select(F.col("path").alias("__file")).distinct().withColumn("__old", F.lit(True))
    at = at.join(files, F.col("path") == F.col("__file"), "left").withColumnRenamed("__old", "__audio").drop("__file")
    at = at.join(files, F.col("__manifest") == F.col("__file"), "left").drop("__file", "__manifest")
    ending = F.lower(F.regexp_extract("path", r"[^/]\.([^./]*)$", 1))
    problem = first_failing((~below(F.col("path"), root), "outside the outputs folder"), (~ending.isin(*OUTPUTS), "unknown ending"), (F.col("__audio") | F.col("__old"), "already exists"))
    return at.withColumn("problem", problem).drop("__audio", "__old")


def model_status(models: DataFrame, files: DataFrame) -> DataFrame:
    """key, name, ready, size_mb of models (key, name, size) by the files there are (key, length)."""
    there = files.groupBy("key").agg(F.sum("length").alias("__length"))
    return models.join(there, "key", "left").select("key", "name", (F.coalesce("__length", F.lit(0)) > 0).alias("ready"), F.round(F.col("size") / 1e6, 1).alias("size_mb"))

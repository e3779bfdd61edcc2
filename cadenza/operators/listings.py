"""Listing views: voices, engines, families to install, devices, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consent, prefix


def voices(entities: DataFrame, ledger: DataFrame, references: DataFrame, tuning: DataFrame) -> DataFrame:
    """voice, speaker, language, consent, ready, references, tuned_engine.  entities: voice, speaker, language; tuning: voice, engine."""
    counts = references.groupBy("voice").agg(F.count(F.lit(1)).alias("references"))
    x = entities.join(consent.current(ledger).select("voice", "status", "usable"), "voice", "left").join(counts, "voice", "left").join(tuning.select("voice", F.col("engine").alias("tuned_engine")), "voice", "left")
    n = F.coalesce("references", F.lit(0))
    return x.select("voice", "speaker", "language", F.coalesce("status", F.lit("none")).alias("consent"), (F.coalesce("usable", F.lit(False)) & (n > 0)).alias("ready"), n.alias("references"), "tuned_engine")


def engines(dimension: DataFrame, installed: DataFrame) -> DataFrame:
    """engine, family, installed, languages (six at most, then ...), notes."""
    there = installed.select("family").distinct().withColumn("__there", F.lit(True))
    few = F.concat(F.array_join(F.slice("languages", 1, 6), ","), F.when(F.size("languages") > 6, "...").otherwise(""))
    return dimension.join(there, "family", "left").select("engine", "family", F.coalesce("__there", F.lit(False)).alias("installed"), few.alias("languages"), F.array_join("tags", ", ").alias("notes"))


def families(names: DataFrame, dimension: DataFrame, gpu: bool) -> DataFrame:
    """family, position: what the asked names (position, name) stand for, each once, in the order of asking; an unknown name is an error."""
    pairs = dimension.select(F.col("engine").alias("name"), "family").unionByName(dimension.select(F.col("family").alias("name"), "family"))
    pairs = pairs.unionByName(dimension.select(F.lit("all").alias("name"), "family"))
    advised = ["chatterbox", "qwen3"] if gpu else ["chatterbox"]
    pairs = pairs.unionByName(dimension.where(F.col("family").isin(advised)).select(F.lit("recommended").alias("name"), "family"))
    found = names.join(F.broadcast(pairs.distinct()), "name", "left")  # a few rows per engine
    known = F.coalesce("family", F.raise_error(F.concat(F.lit("unknown engine or family: "), F.col("name"))).cast("string"))
    return found.groupBy(known.alias("family")).agg(F.min("position").alias("position"))


def device(requested: Column, allowed: Column, available: list[str]) -> Column:
    """The requested device if it is there, else the best that is there, among those the engine allows; cpu at last."""
    fits = lambda d: F.array_contains(allowed, d)
    here = [d for d in ("cuda", "mps", "cpu") if d in available]
    return F.coalesce(F.when(requested.isin(available) & fits(requested), requested), *[F.when(fits(F.lit(d)), F.lit(d)) for d in here], F.lit("cpu"))


def queue(jobs: DataFrame, machine: list[str], arrive: str, took: str, order: list[str]) -> DataFrame:
    """Adds begun and finished for jobs that a machine runs one at a time in order of arrival.

    No loop, and no task that holds a machine's jobs where there are many: see `prefix.in_turn`.
    """
    x = prefix.in_turn(jobs, machine, [F.col(arrive), *[F.col(c) for c in order]], arrive, took)
    return x.withColumn("begun", F.col("finished") - F.col(took))


def lookup(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """job, status (unknown if there is none), error."""
    return asked.select("job").join(jobs.select("job", "status", "error"), "job", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def gpus(listing: Column) -> Column:
    """name and memory (GB) of each line `name, megabytes` of a driver's listing; memory is null where it is no number."""
    lines = F.filter(F.split(listing, r"\r?\n"), lambda x: x.contains(","))
    part = lambda x, k: F.trim(F.get(F.split(x, ","), F.lit(k)))
    return F.transform(lines, lambda x: F.struct(part(x, 0).alias("name"), F.round(part(x, 1).try_cast("double") / 1024, 1).alias("memory_gb")))


# Gigabytes that should be free, and the load (per cent) from which speeds suffer.
FREE_GB, BUSY = 10.0, 50.0


def machine_checks(machines: DataFrame) -> DataFrame:
    """machine, position, check, ok (null: for information only), detail, fix.

    machines: machine, free_gb, busy, missing (encoders and filters not there; null: no tool at all), models and ready
    (names), families (installed), gpu and gpu_usable.
    """
    row = lambda name, ok, detail, fix: F.struct(F.lit(name).alias("check") if isinstance(name, str) else name.alias("check"), ok.cast("boolean").alias("ok"), detail.alias("detail"), F.when(~ok, fix).otherwise("").alias("fix"))
    info, said = F.lit(None).cast("boolean"), F.format_string
    gone = F.array_join("missing", ", ")
    fixed = F.array(
        row("disk", F.col("free_gb") >= FREE_GB, said("%.0f GB free", F.col("free_gb")), "free some space"),
        row("media tool", F.coalesce(F.size("missing") == 0, F.lit(False)), F.when(F.col("missing").isNull(), "not found").when(F.size("missing") > 0, F.concat(F.lit("missing: "), gone)).otherwise("complete"), "install a complete build"),
    )
    load = F.when(F.col("busy") > BUSY, F.array(row("load", info, said("%.0f%% busy, so speeds are low", F.col("busy")), "")))
    models = F.transform("models", lambda m: row(F.concat(F.lit("model "), m), F.when(F.array_contains("ready", m), True), F.when(F.array_contains("ready", m), "ready").otherwise("comes with its first use"), ""))
    idle = F.col("gpu") & ~F.col("gpu_usable")
    engines_ = F.transform("families", lambda f: row(F.concat(F.lit("engine "), f), ~idle, F.when(idle, "installed, but can't use the GPU").otherwise("installed"), "install it again"))
    none = F.when(F.size("families") == 0, F.array(row("engines", F.lit(False), F.lit("none installed"), "install one")))
    nothing = F.slice(fixed, 1, 0)
    every = F.concat(fixed, F.coalesce(load, nothing), models, engines_, F.coalesce(none, nothing))
    return machines.select("machine", F.posexplode(every).alias("position", "c")).select("machine", "position", "c.*")

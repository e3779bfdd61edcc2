"""From measured regions of speech to the references of a voice: which regions to transcribe, which clips to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import signal, vectors
from . import gates, ranking

# Least seconds of a region, seconds that are transcribed, references, and the edges and levels of a reference.
LEAST_REGION, TRANSCRIBED, REFERENCES = 1.5, 600.0, 8
LEAD, TAIL, FADE_IN, FADE_OUT, LEVEL_DB, PEAK_DB = 0.15, 0.3, 0.015, 0.04, -23.0, -1.0


class NothingLeft(ValueError):
    """A step of ingest that leaves nothing to go on with."""


def region_features(samples: Column, sr: Column, embedding: Column) -> Column:
    """What is measured of a region before anything is transcribed: its voice and three signal checks."""
    return F.struct(embedding.alias("emb"), signal.clipping_ratio(samples, 0.99).alias("clipping"), signal.snr_db(samples, 320).alias("snr_db"), signal.bandwidth_hz(samples, sr).alias("bandwidth"))


def features(samples: Column, sr: Column, embedding: Column, words: Column, speech_seconds: Column) -> Column:
    """All measures of a clip as one struct; what needs frames crosses to Python once."""
    x = signal.spectral(samples, sr)
    return F.struct(
        embedding.alias("emb"), signal.clipping_ratio(samples, 0.99).alias("clipping"), signal.snr_db(samples, 320).alias("snr_db"), x["bandwidth"].alias("bandwidth"),
        x["f0_median"].alias("f0_median"), x["f0_range_st"].alias("f0_range_st"), signal.rate_wps(x["f0_median"], words, speech_seconds, F.size(samples) / sr).alias("rate_wps"), signal.rms_db(samples).alias("rms_db"),
    )


def long_enough(regions: DataFrame, least: float = LEAST_REGION) -> DataFrame:
    return regions.where(F.col("duration") >= least)


def minutes(rows: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """keys and, for each condition, the minutes of the rows that fulfil it."""
    return rows.groupBy(*keys).agg(*[F.round(F.coalesce(F.sum(F.when(c, F.col("duration"))), F.lit(0.0)) / 60, 2).alias(n) for n, c in conditions.items()])


def of_target(regions: DataFrame, targets: DataFrame) -> DataFrame:
    """Regions (voice, emb, duration, ...) that sound like their voice's target (voice, target), with sim to it and the cut."""
    near = regions.join(targets, "voice").withColumn("sim", vectors.dot(F.col("emb"), F.col("target"))).drop("target")
    return ranking.adaptive_cut(near, ["voice"], "sim")


def centred(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Rows with sim to their voice's centroid (voice, centroid)."""
    x = rows.drop("sim") if "sim" in rows.columns else rows
    return x.join(centroids.select("voice", "centroid"), "voice").withColumn("sim", vectors.dot(F.col("emb"), F.col("centroid"))).drop("centroid")


def to_transcribe(target_regions: DataFrame, centroids: DataFrame, seconds: float = TRANSCRIBED) -> DataFrame:
    """Clean regions of the target, the most typical and clearest first, until their length passes the budget."""
    x = centred(target_regions, centroids)
    clean = x.where(gates.first_failing(*gates.signal_rules(F.col("clipping"), F.col("bandwidth"), F.col("snr_db"))) == "")
    ranked = ranking.region_rank(clean, ["voice"], "sim", "snr_db", "source", "start")
    return ranking.budget_prefix(ranked, ["voice"], [F.col("place")], "duration", seconds)


def judged(clips: DataFrame, centroids: DataFrame) -> DataFrame:
    """Clips (voice, emb, confidence and the measures) with sim and the reason why one is refused."""
    rules = gates.clip_rules(*map(F.col, ("clipping", "bandwidth", "snr_db", "confidence", "f0_median")))
    return centred(clips, centroids).withColumn("reason", gates.first_failing(*rules))


def references(good: DataFrame, events: Column, k: int = REFERENCES) -> DataFrame:
    """The k references of each voice: scored, spread out, without contaminated ones (events: a map), scored again among those left."""
    chosen = ranking.two_stage(good.withColumn("__clean", gates.contaminants(events) == ""), ["voice"], k, F.col("__clean"))
    name = F.format_string("ref%02d", F.col("chosen"))
    return chosen.select(
        "voice", name.alias("id"), F.concat(F.lit("refs/"), name, F.lit(".wav")).alias("path"), "text", F.round("duration", 2).alias("duration"), "source", F.round("start", 2).alias("start"),
        F.round("score", 3).alias("score"), F.round("sim", 4).alias("similarity"), F.round("snr_db", 1).alias("snr_db"), F.round("f0_median", 1).alias("f0_median"), F.round("rate_wps", 2).alias("rate_wps"),
    )


def reference_signal(samples: Column, sr: int) -> Column:
    """What a reference file holds: faded edges, and a level that the peak allows."""
    return signal.to_level(signal.fade(samples, int(FADE_IN * sr), int(FADE_OUT * sr)), LEVEL_DB, PEAK_DB)


def reference_window(start: Column, duration: Column) -> Column:
    """begin and seconds of the stretch of its source that a reference takes."""
    return F.struct(F.greatest(F.lit(0.0), start - LEAD).alias("begin"), (duration + LEAD + TAIL).alias("seconds"))


def voice_vectors(target_regions: DataFrame, good: DataFrame, chosen: DataFrame) -> DataFrame:
    """voice, centroid (of the target's regions), holdout (of good clips that are no references, if there are three; else the same)."""
    centre = vectors.centroids(target_regions, ["voice"], "emb").select("voice", "centroid")
    rest = good.join(chosen.select("voice", "source", F.round("start", 2).alias("__at")), (good["voice"] == chosen["voice"]) & (good["source"] == chosen["source"]) & (F.round(good["start"], 2) == F.col("__at")), "left_anti")
    held = vectors.centroids(rest, ["voice"], "emb").where("n >= 3").select("voice", F.col("centroid").alias("holdout"))
    return centre.join(held, "voice", "left").withColumn("holdout", F.coalesce("holdout", "centroid"))


def statistics(good: DataFrame) -> DataFrame:
    """Per voice: clean clips and minutes, self-similarity, and medians of pitch, its range and rate."""
    base = good.groupBy("voice").agg(
        F.count(F.lit(1)).alias("clean_clips"), F.round(F.sum("duration") / 60, 2).alias("clean_minutes"), F.round(F.median("f0_median"), 1).alias("f0_median"),
        F.round(F.median("f0_range_st"), 2).alias("f0_range_st"), F.round(F.median("rate_wps"), 3).alias("rate_wps"),
    )
    own = vectors.self_similarity(good, ["voice"], "emb").select("voice", F.round("self_similarity", 4).alias("self_similarity"))
    return base.join(own, "voice")


def run(regions: DataFrame, clips_of, targets: DataFrame, events_of, k: int = REFERENCES, seconds: float = TRANSCRIBED) -> dict[str, DataFrame]:
    """All steps for all voices: references, rejected (reason, n), vectors and stats.

    regions: voice, source, start, duration, emb, clipping, snr_db, bandwidth.  clips_of makes measured clips of the
    regions to transcribe; events_of gives the column of sound events of a clip.  Both stand for models.
    """
    target_regions = of_target(long_enough(regions), targets)
    if not target_regions.limit(1).count():
        raise NothingLeft("no speech matched the target speaker")
    centre = vectors.centroids(target_regions, ["voice"], "emb").select("voice", "centroid")
    chosen_regions = to_transcribe(target_regions, centre, seconds)
    if not chosen_regions.limit(1).count():
        raise NothingLeft("all of the target's speech is clipped, noisy or of low bandwidth")
    clips = judged(clips_of(chosen_regions), centre)
    good = clips.where("reason = ''").drop("reason").withColumn("pos", F.row_number().over(W.partitionBy("voice").orderBy("source", "start")))
    if not good.limit(1).count():
        raise NothingLeft("every clip failed the quality gates")
    refs = references(good, events_of(good), k)
    rejected = clips.where("reason <> ''").groupBy("voice", "reason").agg(F.count(F.lit(1)).alias("n"))
    return {"references": refs, "rejected": rejected, "vectors": voice_vectors(target_regions, good, refs), "stats": statistics(good)}

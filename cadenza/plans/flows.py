"""Whole flows out of the operators: a tournament of engines, and renders from takes to delivery.

What speaks, listens or embeds is a model and stays outside: takes come with what was measured of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import consent, takes
from ..sources import delivery


def tune(tried_takes: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winners (voice, engine, reference, score, similarity, cer, rtf), and all that was tried, of voices that may be used.

    tried_takes: voice, engine, reference and a scored take (ok, similarity, sim_norm, cer, q, rtf).
    """
    tried = takes.tournament(consent.permitted(tried_takes, ledger))
    best = tried.where("winner").select("voice", "engine", "reference", F.round("q", 4).alias("score"), F.round("similarity", 4).alias("similarity"), F.round("cer", 4).alias("cer"), F.round("rtf", 2).alias("rtf"))
    return best, tried


def chosen_parts(scored: DataFrame, quality: str = "balanced") -> DataFrame:
    """The best take of each part of each render: scored takes (render, part, take, ok, q, reason, ...) with all their columns, and takes consumed."""
    preset = next((p for p in takes.PRESETS if p[0] == quality), None)
    if preset is None:
        raise KeyError(f"unknown quality {quality!r}; known: {', '.join(p[0] for p in takes.PRESETS)}")
    keyed = scored.withColumn("__part", F.struct("render", "part"))
    picked = takes.best_of(keyed.select(F.col("__part").alias("part"), "take", "ok", "q", "reason"), preset)
    picked = picked.select(F.col("part").alias("__part"), "take", "consumed")
    return keyed.join(picked, ["__part", "take"]).drop("__part")


def render(scored: DataFrame, requests: DataFrame, ledger: Callable[[], DataFrame], verify: Callable[[DataFrame], DataFrame], target: str, quality: str = "balanced", allow_imperfect: bool = False) -> DataFrame:
    """Chooses, combines, checks and delivers renders; returns one score per render.

    requests: render, voice, speaker, engine.  The consent in force now is the grant; it is read again before delivery.  verify
    adds to the renders what was measured of their finished files: probability, payload, true_peak.
    """
    grants = consent.current(ledger())
    if (no := requests.join(grants.where("usable").select("voice"), "voice", "left_anti").select("voice").first()) is not None:
        raise PermissionError(f"voice {no['voice']!r} has no usable consent")
    chosen = takes.require_passed(chosen_parts(scored, quality), ["render"], allow_imperfect)
    combined = takes.combine(chosen, ["render"], "part", "duration").join(chosen.groupBy("render").agg(F.sum("consumed").alias("takes")), "render")
    whole = combined.join(requests, "render").join(grants.select("voice", "kind", "created"), "voice")
    tagged = whole.withColumn("tags", delivery.disclosure_tags(F.col("voice").cast("string"), F.col("speaker"), F.col("kind"), F.col("engine")))
    delivery.deliver(verify(tagged), ledger, target)
    return whole


def seeds(base: int, parts: DataFrame, n_takes: int) -> DataFrame:
    """Parts (part from 0, ...) with the takes to try and the seed of each."""
    return parts.withColumn("take", F.explode(F.sequence(F.lit(0), F.lit(n_takes - 1)))).withColumn("seed", scalars.take_seed(F.lit(base).cast("long"), F.col("part"), F.col("take")))

"""Joining of takes: trimmed edges, gaps sized by punctuation and filled with room tone; arrays stay on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import signal, text
from ..functions.binding import bound

# Seconds kept around the active part, milliseconds of fade, and the loudest room tone.
GUARD, FADE_IN, FADE_OUT, TONE_DB = 0.025, 8, 12, -55.0
#: Weights of the low-pass over noise: a Hann window of nine points without its zero ends.
_HANN = [0.5 - 0.5 * math.cos(math.pi * k / 4) for k in range(1, 8)]


def room_tone(n: Column, level: Column, *seed: Column) -> Column:
    """n samples of smoothed noise at an RMS of `level`, TONE_DB at most; the seed decides all of them."""
    noise = F.transform(F.sequence(F.lit(0), n + 5), lambda i: F.pmod(F.xxhash64(*seed, i), F.lit(2_000_001)) / 1e6 - 1.0)
    total = sum(_HANN)

    def smooth(raw: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((F.get(raw, i + k) * (w / total) for k, w in enumerate(_HANN)), F.lit(0.0)))

    wanted = F.least(level, F.lit(10 ** (TONE_DB / 20)))
    scaled = lambda s: bound(wanted / (signal.rms(s) + 1e-12), lambda g: F.transform(s, lambda v: v * g))
    return F.when(n > 0, bound(bound(noise, smooth), scaled)).otherwise(F.array().cast("array<double>"))


def seams(parts: DataFrame, keys: list[str], order: str, samples: str, said: str, sr: int, sustained: int = 2, relative_db: float = 40.0) -> DataFrame:
    """keys, order, lo and hi (samples kept of the part), gap (samples after it), begin (its place in the join), n_parts.

    The last part has no gap after it; a render of one part is kept as it is.  Parts of one render are few, and the window
    holds numbers only.
    """
    x, guard = F.col(samples), int(GUARD * sr)
    group = W.partitionBy(*keys)
    rows = parts.select(*keys, order, F.size(x).alias("n"), signal.active_bounds(x, int(0.02 * sr), sustained, relative_db=relative_db).alias("b"), F.floor(text.pause_after(F.col(said)) * sr + 1e-9).cast("int").alias("pause"))
    rows = rows.withColumn("n_parts", F.count(F.lit(1)).over(group)).withColumn("last", F.lead(order).over(group.orderBy(order)).isNull())
    one = F.col("n_parts") == 1
    rows = rows.select(
        *keys, order, "n_parts",
        F.when(one, 0).otherwise(F.greatest(F.lit(0), F.col("b.begin") - guard)).cast("int").alias("lo"),
        F.when(one, F.col("n")).otherwise(F.least(F.col("n"), F.col("b.end") + guard)).cast("int").alias("hi"),
        F.when(F.col("last"), 0).otherwise(F.col("pause")).alias("gap"),
    )
    before = group.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("begin", F.coalesce(F.sum(F.col("hi") - F.col("lo") + F.col("gap")).over(before), F.lit(0)))


def joined(parts: DataFrame, keys: list[str], order: str, samples: str, said: str, sr: int, sustained: int = 2, relative_db: float = 40.0, seed: int = 0) -> DataFrame:
    """keys, n_parts, samples: one signal per render; the gaps carry the median noise floor of its parts."""
    x = F.col(samples)
    floor = F.pow(F.lit(10.0), signal.percentile(signal.frame_levels(x, int(0.02 * sr)), 0.05) / 20)
    rows = parts.select(*keys, order, x.alias("__x"), floor.alias("__floor")).join(seams(parts, keys, order, samples, said, sr, sustained, relative_db), [*keys, order])
    floors = rows.groupBy(*keys).agg(F.median("__floor").alias("__level"))
    rows = rows.join(floors, keys)
    cut = F.slice("__x", F.col("lo") + 1, F.col("hi") - F.col("lo")).cast("array<double>")
    part = F.when(F.col("n_parts") == 1, F.col("__x").cast("array<double>")).otherwise(signal.fade(cut, int(FADE_IN * sr / 1000), int(FADE_OUT * sr / 1000)))
    tone = room_tone(F.col("gap"), F.col("__level"), F.lit(seed), *[F.col(k) for k in keys], F.col(order))
    rows = rows.select(*keys, order, F.concat(part, tone).alias("piece"))
    gathered = F.array_sort(F.collect_list(F.struct(order, "piece")))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parts"), F.flatten(F.transform(gathered, lambda p: p["piece"])).alias("samples"))

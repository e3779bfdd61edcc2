"""Quality gates: ordered rules, the first that fails gives the reason, no reason passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Event labels that spoil a reference clip.
BAD_EVENTS = (
    "Music", "Musical instrument", "Singing", "Laughter", "Giggle", "Chuckle, chortle", "Applause", "Cheering", "Crowd", "Chatter",
    "Hubbub, speech noise, speech babble", "Television", "Radio", "Static", "Noise", "Wind noise (microphone)", "Echo", "Reverberation",
)


def first_failing(*rules: tuple[Column, Column | str]) -> Column:
    """The reason of the first rule that holds; an empty string if none does.  A null condition doesn't hold."""
    out = None
    for failed, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out.otherwise(F.lit(""))


def signal_rules(clipping: Column, bandwidth: Column, snr: Column, max_clipping=0.001, min_bandwidth=6000, min_snr=18):
    return [(clipping > max_clipping, "clipped"), (bandwidth < min_bandwidth, "low bandwidth"), (snr < min_snr, "noisy")]


def clip_rules(clipping, bandwidth, snr, confidence, f0_median, min_confidence=0.55, **signal):
    return [*signal_rules(clipping, bandwidth, snr, **signal), (confidence < min_confidence, "unclear speech"), (f0_median <= 0, "no voiced speech")]


def histogram(df: DataFrame, reason: str, position: str) -> DataFrame:
    """reason, n, first_position of rejected rows; the most frequent come first, then the first seen."""
    bad = df.where(F.col(reason) != "").groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_position"))
    return bad.orderBy(F.desc("n"), "first_position")


def contaminants(events: Column, threshold: float = 0.2, bad: tuple[str, ...] = BAD_EVENTS) -> Column:
    """`contains a, b` for bad labels (of a map label -> probability) at or over the threshold, else empty."""
    found = F.array_sort(F.map_keys(F.map_filter(events, lambda k, v: k.isin(*bad) & (v >= threshold))))
    return F.when(F.size(found) > 0, F.concat(F.lit("contains "), F.array_join(found, ", "))).otherwise("")


def length_plausible(duration: Column, expected: Column, low=0.5, high=2.0) -> Column:
    ratio = duration / F.greatest(F.lit(0.5), expected)
    return (ratio >= low) & (ratio <= high + 1.5 / F.greatest(F.lit(0.5), expected))


# The reasons that the rules below give; whoever reads results compares them.


def take_rules(broken: Column, duration: Column, clipping: Column, expected: Column):
    """Rules of a take's sound; they come before any transcript."""
    length = F.format_string("implausible length (%.1fs for ~%.1fs of text)", duration, expected)
    return [(broken | (duration < 0.3), "empty or broken audio"), (clipping > 0.001, "clipping"), (~length_plausible(duration, expected), length)]


def wording_rules(script: Column, heard: Column, cer: Column, repeated: Column, longest: Column, max_cer=0.08, max_pause=1.6):
    """Rules of a take's words (script and transcript normalised): ending, repetition, errors, pauses."""
    s, h = text.words(script), text.words(heard)
    tail = lambda n: F.slice(h, F.greatest(F.size(h) - (n - 1), F.lit(1)), n)
    last = F.get(s, F.size(s) - 1)
    cut_off = (F.size(s) > 0) & ~F.array_contains(tail(3), last) & (text.cer(last, F.array_join(tail(2), " ")) > 0.5)
    quoted = F.when(repeated.contains("'"), F.concat(F.lit('"'), repeated, F.lit('"'))).otherwise(F.concat(F.lit("'"), repeated, F.lit("'")))
    return [
        (cut_off, "ending cut off or garbled"),
        (repeated.isNotNull(), F.concat(F.lit("repeated phrase: "), quoted)),
        (cer > max_cer, F.format_string("wording off (character error %.0f%%)", cer * 100)),
        (longest > max_pause, F.format_string("dead air (%.1fs pause)", longest)),
    ]


def identity_rule(similarity: Column, least=0.40):
    return similarity < least, F.format_string("does not sound like the speaker (similarity %.2f)", similarity)


def delivery_reason(probability: Column, payload: Column, tags_ok: Column, true_peak: Column, ceiling: float = -1.5) -> Column:
    """Why a delivered file is refused.  What isn't known counts as failed."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return first_failing((~yes((probability >= 0.5) & payload), "watermark not found"), (~yes(tags_ok), "disclosure tags missing"), (~yes(true_peak <= ceiling + 1.0), "too loud"))


def probe(banner: Column) -> Column:
    """duration (seconds), codec, sample_rate, channels out of a media banner."""
    time = lambda k: F.regexp_extract(banner, r"Duration: (\d+):(\d\d):(\d\d(?:\.\d+)?)", k).try_cast("double")
    audio = lambda k: F.regexp_extract(banner, r"Audio: (\w+)[^\n]*?, (\d+) Hz, (\w+)", k)
    return F.struct((time(1) * 3600 + time(2) * 60 + time(3)).alias("duration"), F.nullif(audio(1), F.lit("")).alias("codec"), audio(2).try_cast("int").alias("sample_rate"), F.when(audio(3) == "mono", 1).when(audio(3) == "stereo", 2).alias("channels"))

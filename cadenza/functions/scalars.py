"""Small scalar rules as Column expressions: gains, seeds, options, times, names, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The loudness aimed at (LUFS), the highest true peak (dBTP), how times are written, and what a name may be.
TARGET_LUFS, CEILING_DBTP = -16.0, -1.5
STAMP, MOMENT = "yyyyMMdd-HHmmss", "yyyy-MM-dd'T'HH:mm:ss'Z'"
NAME = r"^[a-z0-9][a-z0-9_-]{0,62}\n?$"


def loudness_gain(integrated: Column, true_peak: Column, target: float = TARGET_LUFS, ceiling: float = CEILING_DBTP) -> Column:
    """Decibels towards the target, as far as the peak allows; null for silence."""
    silent = integrated.isNull() | F.isnan(integrated) | (F.abs(integrated) == float("inf"))
    return F.when(~silent, F.least(F.lit(target) - integrated, F.lit(ceiling) - true_peak))


def options(language: Column, tuned: Column, same_engine: Column, explicit: Column) -> Column:
    """The language, then what was tuned on the same engine, then what was asked for; the later wins."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    over = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    base = over(F.create_map(F.lit("language"), language), F.coalesce(F.when(same_engine, tuned), none))
    return over(base, F.coalesce(explicit, none))


def take_seed(base: Column, part: Column, take: Column) -> Column:
    """Parts and takes count from 0."""
    return base + 1000 * part + take


def real_time_factor(seconds: Column, duration: Column) -> Column:
    return seconds / F.greatest(F.lit(0.1), duration)


def moment(at: Column) -> Column:
    return F.date_format(at, MOMENT)


def stamp(at: Column) -> Column:
    return F.date_format(at, STAMP)


def log_tail(lines: Column, n: int = 6) -> Column:
    """The last n lines."""
    return F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), n)


def name_ok(name: Column) -> Column:
    """Names become folders: lower-case letters, digits, - and _, 63 at most; one line feed at the end is let through."""
    return F.coalesce(name.rlike(NAME), F.lit(False))


def fingerprint(values: Column) -> Column:
    """16 hexadecimal digits of a list's JSON."""
    return F.left(F.sha2(F.to_json(values), 256), F.lit(16))

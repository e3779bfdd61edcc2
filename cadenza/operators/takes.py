"""Scores of takes, best of N with early stop, tournaments, and the choice of engines and references."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import signal, text
from . import gates, prefix

# Presets (name, takes, quality that is enough) and the engine dimension.
PRESETS = (("fast", 2, 0.0), ("balanced", 4, 0.80), ("best", 8, 0.93))
_TEN = ["en", "zh", "ja", "ko", "de", "fr", "ru", "pt", "es", "it"]
_MANY = ["ar", "da", "de", "el", "en", "es", "fi", "fr", "he", "hi", "it", "ja", "ko", "ms", "nl", "no", "pl", "pt", "ru", "sv", "sw", "tr", "zh"]
ENGINES = (
    ("chatterbox-turbo", "chatterbox", ["en"], 7.0, 10.0, 300, ["default-cpu", "paralinguistic-tags"]),
    ("chatterbox-nano", "chatterbox", ["en"], 7.0, 10.0, 300, ["fast"]),
    ("chatterbox-multilingual", "chatterbox", _MANY, 7.0, 10.0, 300, ["multilingual"]),
    ("qwen3-tts-0.6b", "qwen3", _TEN, 6.0, 12.0, 600, ["identity", "long-form"]),
    ("qwen3-tts-1.7b", "qwen3", _TEN, 6.0, 12.0, 600, ["identity", "long-form", "gpu-preferred"]),
    ("sopro", "sopro", ["en", "pt", "fr", "de"], 5.0, 15.0, 400, ["fast"]),
)
DEVICE_ORDER = {
    "cuda": ["qwen3-tts-1.7b", "chatterbox-turbo", "qwen3-tts-0.6b", "chatterbox-multilingual"],
    "mps": ["chatterbox-turbo", "qwen3-tts-0.6b", "chatterbox-multilingual", "chatterbox-nano"],
    "cpu": ["chatterbox-turbo", "qwen3-tts-0.6b", "chatterbox-nano", "sopro", "chatterbox-multilingual"],
}
SIM_FLOOR, CEILING, RATE_WPS = 0.15, 0.8, 2.6
FIRST_SEED = 1234


def engines(spark: SparkSession) -> DataFrame:
    schema = "engine string, family string, languages array<string>, window_low double, window_high double, max_chars int, tags array<string>, position int"
    return spark.createDataFrame([(*e, k) for k, e in enumerate(ENGINES)], schema).coalesce(1)


def for_language(dimension: DataFrame, language: str) -> DataFrame:
    return dimension.where(F.array_contains("languages", language))


def candidates(dimension: DataFrame, installed: DataFrame, language: str, device: str) -> DataFrame:
    """Engines worth trying: of the language, installed, not for a GPU on a CPU, not multilingual for English."""
    fit = for_language(dimension, language).join(installed, "family", "left_semi")
    if device == "cpu":
        fit = fit.where(~F.array_contains("tags", "gpu-preferred"))
    return fit.where(~F.array_contains("tags", "multilingual")) if language == "en" else fit


def engine(dimension: DataFrame, name: str) -> DataFrame:
    """The row of an engine; an unknown name is an error that lists the known ones."""
    row = dimension.where(F.col("engine") == name)
    if not row.limit(1).count():
        raise KeyError(f"unknown engine {name!r}; known: {', '.join(sorted(r['engine'] for r in dimension.select('engine').collect()))}")
    return row


def asked_candidates(dimension: DataFrame, installed: DataFrame, language: str, device: str, asked: list[str] | None = None) -> DataFrame:
    """Engines to try: those asked for, whatever they are fit for, else the candidates."""
    if not asked:
        return candidates(dimension, installed, language, device)
    for name in asked:
        engine(dimension, name)
    return dimension.where(F.col("engine").isin(asked))


def choose_engine(requests: DataFrame, dimension: DataFrame, installed: DataFrame, device: str) -> DataFrame:
    """Requests (voice, language, requested, quality, fast_pick, tuned) with `engine` and `problem`.

    Requested, else the fast pick for `fast`, else tuned, else the first of the device's order that speaks the language; each
    only if its family is installed.  A requested engine that is not installed is a problem, not passed over.
    """
    there = dimension.join(installed.select("family").distinct(), "family", "left_semi")
    order = F.array(*map(F.lit, DEVICE_ORDER[device]))
    ranked = there.select("engine", "languages", F.array_position(order, F.col("engine")).alias("rank")).where("rank > 0")
    default = ranked.select("engine", "rank", F.explode("languages").alias("__language")).groupBy("__language").agg(F.min_by("engine", "rank").alias("__default"))
    usable = F.array_sort(F.collect_set("engine")).alias("__installed")
    x = requests.crossJoin(F.broadcast(there.agg(usable)))  # one row
    x = x.join(F.broadcast(default), F.col("language") == F.col("__language"), "left")  # a row per language
    here = lambda c: F.when(F.array_contains("__installed", c), c)
    picked = F.coalesce(here(F.when(F.col("quality") == "fast", F.col("fast_pick"))), here(F.col("tuned")), F.col("__default"))
    problem = gates.first_failing(
        (F.col("requested").isNotNull() & here(F.col("requested")).isNull(), F.concat(F.lit("not installed: "), F.col("requested"))),
        (F.col("requested").isNull() & picked.isNull(), "no installed engine speaks the language"),
    )
    return x.withColumn("problem", problem).withColumn("engine", F.when(F.col("problem") == "", F.coalesce("requested", picked))).drop("__installed", "__language", "__default")


def choose_reference(requests: DataFrame, references: DataFrame, tried: DataFrame, dimension: DataFrame) -> DataFrame:
    """Requests (voice, engine, requested, tuned_engine, tuned_reference) with `reference` and `problem`.

    Requested, else the tuned one if it was tuned on this engine, else the one that was most similar on it in the tournament
    (tried: voice, engine, reference, similarity), else the best of those that fit the engine's window (references: voice,
    reference, duration, score).
    """
    near = -F.round(F.col("similarity").cast("double"), 9)
    tried = _bounded(tried, ["voice", "engine"], [near.isNotNull(), F.isnan(near)], near, "reference", 1, _few_voices(references))
    best = tried.groupBy("voice", "engine").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), "reference"))["reference"].alias("__tried"))
    fitting = references_for(references, dimension, 1).select("voice", "engine", F.col("reference").alias("__fits"))
    # dealt out first: one task's part of the table may hold as many different ones as all others together
    known = references.select("voice", F.col("reference").alias("__known")).repartition("voice", "__known").distinct()
    some = references.select("voice").distinct().withColumn("__some", F.lit(True))
    x = requests.join(best, ["voice", "engine"], "left").join(fitting, ["voice", "engine"], "left").join(some, "voice", "left")
    tuned = F.when(F.col("tuned_engine") == F.col("engine"), F.col("tuned_reference"))
    # the tournament speaks for a voice only if it has been tuned
    x = x.withColumn("reference", F.coalesce("requested", tuned, F.when(F.col("tuned_engine").isNotNull(), F.col("__tried")), "__fits"))
    x = x.join(known.withColumnRenamed("voice", "__voice"), (F.col("voice") == F.col("__voice")) & (F.col("reference") == F.col("__known")), "left")
    problem = gates.first_failing((F.col("__some").isNull(), "no references yet"), (F.col("__known").isNull(), F.concat(F.lit("no such reference: "), F.col("reference"))))
    return x.withColumn("problem", problem).withColumn("reference", F.when(F.col("problem") == "", F.col("reference"))).drop("__tried", "__fits", "__some", "__known", "__voice")


def probes(voices: DataFrame, references: DataFrame, sentences: DataFrame, n: int) -> DataFrame:
    """voice, place, text: the first n probe sentences (language, place from 1, text) of a voice's language.

    A language without sentences borrows the texts of the voice's references with the lowest scores, which are no prompts; a
    voice without references takes the English ones.
    """
    score = F.col("score").cast("double")
    own = _bounded(references, ["voice"], [score.isNotNull(), F.isnan(score)], score, "reference", n, _few_voices(references))
    own = own.withColumn("place", F.row_number().over(W.partitionBy("voice").orderBy("score", "reference"))).where(F.col("place") <= n)
    spoken = sentences.where(F.col("place") <= n)
    has = spoken.select("language").distinct()
    listed = voices.join(spoken, "language")
    rest = voices.join(has, "language", "left_anti")
    borrowed = rest.join(own.select("voice", "place", "text"), "voice")
    english = rest.join(own.select("voice").distinct(), "voice", "left_anti").crossJoin(F.broadcast(spoken.where("language = 'en'").select("place", "text")))  # n rows
    return listed.select("voice", "place", "text").unionByName(borrowed.select("voice", "place", "text")).unionByName(english.select("voice", "place", "text"))


def trials(references: DataFrame, dimension: DataFrame, probe_rows: DataFrame, n_references: int) -> DataFrame:
    """voice, engine, reference, probe, text, seed: each engine's best references with each probe sentence of the voice."""
    picked = references_for(references, dimension, n_references).select("voice", "engine", "reference", F.col("place").alias("rank"))
    each = picked.join(probe_rows.withColumnsRenamed({"place": "probe"}), "voice")
    return each.select("voice", "engine", "reference", "rank", "probe", "text", (F.lit(FIRST_SEED) + F.col("probe") - 1).alias("seed"))


def within_budget(runs: DataFrame, keys: list[str], order: list[str], cost: str, seconds: float) -> DataFrame:
    """Runs in order until the costs on record have passed the budget; the run that passes it is still done."""
    return prefix.running(runs, keys, [F.col(c) for c in order], cost, "__spent", F.col("__spent") <= seconds).drop("__spent")


def sim_norm(similarity: Column, ceiling: Column) -> Column:
    return F.least(F.lit(1.2), F.greatest(F.lit(0.0), (similarity - SIM_FLOOR) / F.greatest(F.lit(0.1), ceiling - SIM_FLOOR)))


def ratio(value: Column, reference: Column) -> Column:
    """1 where either side is zero or missing."""
    return F.coalesce(F.nullif(value, F.lit(0.0)) / F.nullif(reference, F.lit(0.0)), F.lit(1.0))


def quality(norm: Column, cer: Column, f0_ratio: Column, rate_ratio: Column) -> Column:
    prosody = F.exp(-F.abs(F.log(f0_ratio)) / 0.15) * F.exp(-F.abs(F.log(rate_ratio)) / 0.25)
    return 0.5 * F.least(F.lit(1.0), norm) + 0.35 * F.exp(-cer / 0.03) + 0.15 * prosody


def evaluate(takes: DataFrame) -> DataFrame:
    """The whole scorer: keeps the columns and adds or sets ok, reason (of the first gate that fails), q and what it is made of.

    takes: samples, sr, script, transcript, words (structs with start and end in seconds), similarity, f0_median and
    rate_wps of the take; self_similarity, voice_f0 and voice_rate of its voice.  What is missing counts as the
    reference's default.  A take refused for its sound alone is scored as if nothing had been heard.
    """
    dead = F.exists("samples", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    known = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    x = takes.withColumns({"__s": text.normalise(F.coalesce("script", F.lit(""))), "__h": text.normalise(F.coalesce("transcript", F.lit("")))})
    x = x.withColumns({"__cer": text.cer(F.col("__s"), F.col("__h")), "__wer": text.wer("__s", "__h"), "__rep": text.repeated_trigram("__s", "__h")})
    gaps = F.transform("words", lambda w, i: F.when(i > 0, w["start"] - F.get(F.col("words"), i - 1)["end"]))
    x = x.withColumns({
        "duration": F.coalesce(F.size("samples") / F.col("sr"), F.lit(0.0)),
        "expected": F.size(text.words(F.col("__s"))) / F.greatest(F.lit(1.2), known(F.col("voice_rate"), RATE_WPS)),
        "longest_pause": F.coalesce(F.array_max(gaps), F.lit(0.0)), "similarity": F.coalesce("similarity", F.lit(0.0)),
    })
    sound = gates.take_rules(F.coalesce(dead, F.lit(True)), F.col("duration"), signal.clipping_ratio(F.col("samples"), 0.999), F.col("expected"))
    wording = gates.wording_rules(F.col("__s"), F.col("__h"), F.col("__cer"), F.col("__rep"), F.col("longest_pause"))
    x = x.withColumn("__refused", gates.first_failing(*sound) != "").withColumn("reason", gates.first_failing(*sound, *wording, gates.identity_rule(F.col("similarity"))))
    heard = lambda c, blank: F.when(F.col("__refused"), F.lit(blank)).otherwise(c)
    x = x.withColumns({
        "ok": F.col("reason") == "", "cer": heard(F.col("__cer"), 1.0), "wer": heard(F.col("__wer"), 1.0), "longest_pause": heard(F.col("longest_pause"), 0.0),
        "sim_norm": heard(sim_norm(F.col("similarity"), known(F.col("self_similarity"), CEILING)), 0.0), "similarity": heard(F.col("similarity"), 0.0),
        "f0_ratio": heard(ratio(F.col("f0_median"), F.col("voice_f0")), 1.0), "rate_ratio": heard(ratio(F.col("rate_wps"), F.col("voice_rate")), 1.0),
    })
    q = quality(F.col("sim_norm"), F.col("cer"), F.col("f0_ratio"), F.col("rate_ratio"))
    return x.withColumn("q", heard(q, 0.0)).drop("__s", "__h", "__cer", "__wer", "__rep", "__refused")


def with_twins(takes: DataFrame) -> DataFrame:
    """Takes (part, take, ok, q, polished, ...) with one row per take: the polished twin where it passes and beats the raw take that passes.

    `passes` counts those of the two that pass, as the early stop does.
    """
    cols = [c for c in takes.columns if c not in ("part", "take")]
    raw, twin = (F.max(F.when(F.col("polished") == p, F.struct(*cols))) for p in (False, True))
    x = takes.groupBy("part", "take").agg(raw.alias("r"), twin.alias("t"))
    better = F.coalesce(F.col("r.ok") & F.col("t.ok") & (F.col("t.q") > F.col("r.q")), F.lit(False))
    passes = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("r.ok", "t.ok")), F.lit(0))
    return x.select("part", "take", F.when(better, F.col("t")).otherwise(F.col("r")).alias("b"), passes.alias("passes")).select("part", "take", "b.*", "passes")


def best_of(takes: DataFrame, preset: tuple[str, int, float]) -> DataFrame:
    """Per part: the take chosen, takes consumed, and ok.  takes: part, take (from 1), ok, q, and maybe reason and passes.

    Takes run in order until the best passing one is good enough or enough have passed; two takes more than
    asked for are allowed (one for `fast`).
    """
    name, most, enough = preset
    order = W.partitionBy("part").orderBy("take")
    so_far, earlier = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    x = takes.where(F.col("take") <= most + (1 if name == "fast" else 2))
    passed = F.sum(F.col("passes") if "passes" in takes.columns else F.when(F.col("ok"), 1).otherwise(0)).over(so_far)
    good = F.max(F.when(F.col("ok"), F.col("q"))).over(so_far)
    stop = F.coalesce(good >= enough, F.lit(False)) | ((passed >= most) & good.isNotNull())
    x = x.withColumn("stop", stop).withColumn("used", ~F.coalesce(F.max("stop").over(earlier), F.lit(False))).where("used")
    more = ["reason"] if "reason" in takes.columns else []
    best = F.min(F.struct((~F.col("ok")).alias("bad"), (-F.col("q")).alias("low"), "take", *more)).alias("b")
    x = x.groupBy("part").agg(best, F.count(F.lit(1)).alias("consumed"))
    return x.select("part", F.col("b.take").alias("take"), (~F.col("b.bad")).alias("ok"), (-F.col("b.low")).alias("q"), "consumed", *[F.col(f"b.{c}") for c in more])


class NeverPassed(ValueError):
    """No take of a part has passed its checks."""


def fail_closed(chosen: DataFrame, keys: list[str], allow_imperfect: bool = False) -> DataFrame:
    """Per render: ok to go on, and the problem of its first part (part, ok, reason) that never passed."""
    first = F.min(F.when(~F.col("ok"), F.struct("part", "reason"))).alias("f")
    # Fixed value: the wording of the problem.
    x = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parts"), first)
    problem = F.when(F.col("f").isNull() | F.lit(allow_imperfect), F.lit("")).otherwise(F.concat(F.lit("part "), F.col("f.part"), F.lit(" never passed the checks (last problem: "), F.col("f.reason"), F.lit(")")))
    return x.select(*keys, "n_parts", (problem == "").alias("ok"), problem.alias("problem"))


def require_passed(chosen: DataFrame, keys: list[str], allow_imperfect: bool = False) -> DataFrame:
    """The chosen takes, if all renders may go on; else NeverPassed."""
    bad = fail_closed(chosen, keys, allow_imperfect).where("NOT ok").select("problem").first()
    if bad is not None:
        raise NeverPassed(bad["problem"])
    return chosen


MEANS = ("q", "cer", "wer", "similarity", "sim_norm", "f0_ratio", "rate_ratio")
SUMS = ("duration", "expected")


def combine(parts: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """One score per render: weighted means, summed durations, the longest pause, all ok, reasons of failed parts and transcripts joined in order.

    A render of one part keeps its scores as they are.  Parts that weigh nothing together count evenly.  Scores that
    parts don't have are left out.
    """
    has = [c for c in (*MEANS, *SUMS, "transcript") if c in parts.columns]
    weights = F.sum(weight)
    mean = lambda c: F.when(F.count(F.lit(1)) == 1, F.max(c)).otherwise(F.coalesce(F.sum(F.col(c) * F.col(weight)) / F.nullif(weights, F.lit(0)), F.avg(c))).alias(c)
    listed = lambda c, of: F.array_sort(F.collect_list(F.when(of, F.struct(order, F.col(c).alias("x")))))
    joined = lambda c, of, by: F.array_join(F.transform(listed(c, of), lambda s: s["x"]), by).alias(c)
    scores = [mean(c) for c in MEANS if c in has] + [F.sum(c).alias(c) for c in SUMS if c in has]
    scores += [F.max("longest_pause").alias("longest_pause"), F.every("ok").alias("ok"), joined("reason", ~F.col("ok"), "; ")]
    return parts.groupBy(*keys).agg(*scores, *([joined("transcript", F.lit(True), " ")] if "transcript" in has else []))


def tournament(takes: DataFrame) -> DataFrame:
    """Means per engine and reference over its takes, and the winner: viable ones first, then q, similarity, name."""
    means = [F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("pass_rate"), F.avg("similarity").alias("similarity"), F.avg(F.least(F.lit(1.0), "sim_norm")).alias("sim_norm"), *[F.avg(c).alias(c) for c in ("cer", "q", "rtf")]]
    rows = takes.groupBy("voice", "engine", "reference").agg(*means)
    # rounded before ranking, so that sums in another order can't turn a tie
    tie = [F.desc(F.col("pass_rate") >= 0.5), F.desc(F.round("q", 9)), F.desc(F.round("similarity", 9)), "engine", "reference"]
    return rows.withColumn("winner", F.row_number().over(W.partitionBy("voice").orderBy(*tie)) == 1)


def fast_pick(tried: DataFrame, slack: float = 0.04, there: DataFrame | None = None) -> DataFrame:
    """Per voice: the cheapest combination within `slack` of the best similarity; rows that mostly fail don't count, nor engines that are not `there`."""
    x = tried.where(F.coalesce("pass_rate", F.lit(0.0)) >= 0.5)
    if there is not None:
        x = x.join(F.broadcast(there.select("engine").distinct()), "engine", "left_semi")
    x = x.withColumn("__best", F.max("similarity").over(W.partitionBy("voice"))).where(F.round("similarity", 9) >= F.round(F.col("__best") - slack, 9))
    return x.withColumn("__n", F.row_number().over(W.partitionBy("voice").orderBy(F.round(F.coalesce("rtf", F.lit(99.0)), 9), "engine", "reference"))).where("__n = 1").drop("__best", "__n")


def references_for(references: DataFrame, dimension: DataFrame, n: int, low: float = 1.5, high: float = 3.0) -> DataFrame:
    """The n references of each engine: those inside its window (with slack) first, then by score."""
    inside = F.col("duration").between(F.col("window_low") - low, F.col("window_high") + high)
    both = references.join(F.broadcast(dimension), F.lit(True)).withColumn("fits", inside)  # six engines
    # downward, nulls last; of numbers, NaN is the largest
    score, fits = F.col("score").cast("double"), F.col("fits")
    flags = [fits.isNull(), ~F.coalesce(fits, F.lit(False)), score.isNull(), ~F.isnan(score)]
    both = _bounded(both, ["voice", "engine"], flags, -score, "reference", n, _few_voices(references))
    return both.withColumn("place", F.row_number().over(W.partitionBy("voice", "engine").orderBy(F.desc("fits"), F.desc("score"), "reference"))).where(F.col("place") <= n)


#: Buckets for each row wanted of a group: the more, the nearer a bound is to the last row wanted.  Voices up to which bounds are broadcast.
BUCKETS, VOICES = 8, 10_000


def _bounded(rows: DataFrame, keys: list[str], flags: list[Column], value: Column, tie: str, n: int, few: bool) -> DataFrame:
    """Rows among which the first n of each group by (flags, value, tie), all upward, are, and few more, found without sorting the others.

    Rows fall into buckets by a hash; the n-th of the buckets' best values has n rows up to it, so none beyond it is wanted.  A group of
    fewer buckets than n is kept whole.  Flags and a double are aggregated by hash; rows as good as the bound stay, whatever their tie.
    few: a bound for each group may be broadcast.
    """
    named = [c.alias(f"__f{i}") for i, c in enumerate(flags)]
    place = F.struct(*named, value.alias("__v"))
    bucket = F.pmod(F.xxhash64(value, tie), F.lit(n * BUCKETS)).alias("__bucket")
    best = rows.groupBy(*keys, *named, bucket).agg(F.min(value).alias("__v"))
    best = best.groupBy(*keys, "__bucket").agg(F.min(F.struct(*[f"__f{i}" for i in range(len(flags))], "__v")).alias("__best"))  # a bucket counts once
    bounds = best.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.get(F.array_sort(F.collect_list("__best")), F.lit(n - 1)).alias("__bound"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    near = rows.join(F.broadcast(bounds) if few else bounds, same).where(F.col("__bound").isNull() | (place <= F.col("__bound")))
    return near.select(*rows.columns)


def _few_voices(references: DataFrame) -> bool:
    return references.select("voice").distinct().limit(VOICES + 1).count() <= VOICES

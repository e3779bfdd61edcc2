"""Groups that no single task should hold: the same results as plain windows and scans."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import listings, prefix, ranking


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables would be put into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def costs(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), k, rng.choice([0.25, 1.5, 4.0, None])) for k in range(4000)] + [("b", 1, 900.0), ("b", 2, 1.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, n int, d double").repartition(5)


def test_budget_of_a_hot_group(spark):
    df = costs(spark)
    for keys in (["k"], []):
        plain, large = (sorted(map(str, ranking.budget_prefix(df, keys, [F.desc("n"), F.col("d")], "d", 700.0, large=x).collect())) for x in (False, True))
        assert plain == large and 0 < len(plain) < 4002
    sizes = [r["count"] for r in prefix.ranged(df, ["k"], [F.col("n")]).groupBy("__part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * 4002 / len(sizes)  # the hot group lies over most partitions
    assert ranking.budget_prefix(df.where("false"), ["k"], [F.col("n")], "d", 5.0, large=True).collect() == []


def test_partitions_behind_the_budget_are_left_alone(spark):
    df = spark.range(100_000).select(F.lit("one").alias("k"), F.col("id").alias("n"), F.lit(1.0).alias("d"))
    x = ranking.budget_prefix(df, ["k"], [F.col("n")], "d", 100.0, large=True)
    assert x.count() == 100 and x.agg(F.max("spent_before")).first()[0] == 99.0
    parts = prefix.ranged(df, ["k"], [F.col("n")]).groupBy("k", "__part").agg(F.sum("d").alias("__total"))
    assert parts.count() >= 8 and prefix.starts(parts, ["k"], "__total", "s").where("s < 100.0").count() == 1


def test_a_machine_with_very_many_jobs(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randrange(0, 40_000), k, rng.randrange(1, 30)) for k in range(3000)]
    df = spark.createDataFrame(rows, "m int, at long, job long, took long").repartition(4)
    want, free = [], {}
    for m, at, job, took in sorted(rows):
        free[m] = max(at, free.get(m, at)) + took
        want.append((m, job, free[m]))
    for large in (False, True):
        got = prefix.in_turn(df, ["m"], [F.col("at"), F.col("job")], "at", "took", large)
        assert sorted((r["m"], r["job"], r["finished"]) for r in got.collect()) == sorted(want)
    assert {r["begun"] + r["took"] - r["finished"] for r in listings.queue(df, ["m"], "at", "took", ["job"]).collect()} == {0}


def scan(rows, k, apart=60.0, alike=0.97):
    """One scan over a pool in order."""
    out, taken = [], []
    for pos, source, start, score, v in sorted(rows, key=lambda r: (-r[3], r[0])):
        u = np.array(v) / (np.linalg.norm(v) + 1e-9)
        if len(taken) < k and not any((source is not None and s == source and start is not None and t is not None and abs(t - start) < apart) or w @ u > alike for s, t, w in taken):
            taken.append((source, start, u))
            out.append((pos, len(taken)))
    return out


@pytest.mark.parametrize("head", [4, 256])
def test_diverse_choice_equals_a_scan(spark, monkeypatch, head):
    monkeypatch.setattr(ranking, "HEAD", head)
    rng = random.Random(4)
    axes = np.eye(5)
    rows = []
    for pool in ("a", "b", None):
        for i in range(400 if pool == "a" else 60):
            v = (axes[rng.choice([0, 0, 0, 0, 1, 2, 3, 4])] + 0.2 * np.array([rng.random() for _ in range(5)])).round(3).tolist()
            rows.append((pool, i, rng.choice(["x", "y", None]), rng.choice([None, float(rng.randrange(900))]), rng.choice([0.5, float(rng.randrange(100))]), v))
    schema = "pool string, pos long, source string, start double, score double, emb array<double>"
    broken = [("a", 1000, "x", 1.0, None, [1.0] * 5), ("a", 1001, "x", 1.0, 500.0, None), ("a", 1002, "x", 1.0, 500.0, [1.0, None] * 2), ("c", 1003, "x", 1.0, None, None), ("d", 7, "x", 1.0, 1.0, [0.0] * 5)]
    df = spark.createDataFrame(rows + broken, schema).repartition(3)
    for k in (3, 12):
        got = {}
        for r in ranking.diverse_top(df, ["pool"], k).collect():
            got.setdefault(r["pool"], []).append((r["pos"], r["chosen"]))
        want = {p: scan([r[1:] for r in rows if r[0] == p], k) for p in ("a", "b", None)} | {"d": [(7, 1)]}
        assert {p: sorted(x, key=lambda y: y[1]) for p, x in got.items()} == want
    whole = [(r[0] or "", *r[1:]) for r in rows]
    one = spark.createDataFrame([(None, i, *r[2:]) for i, r in enumerate(whole)], schema)
    assert sorted(((r["pos"], r["chosen"]) for r in ranking.diverse_top(one, [], 7).collect()), key=lambda y: y[1]) == scan([(i, *r[2:]) for i, r in enumerate(whole)], 7)
    assert ranking.diverse_top(df.where("false"), ["pool"], 3).collect() == []


def test_scores_are_the_same_for_large_tables(spark, monkeypatch):
    rng = random.Random(6)
    cols = "sim confidence snr_db f0_median rate_wps duration".split()
    rows = [(rng.choice(["p", "p", "q", None]), k, *[None if rng.random() < 0.03 else rng.choice([1.0, 2.5, rng.uniform(0.5, 9)]) for _ in cols]) for k in range(800)]
    df = spark.createDataFrame(rows, "k string, n int, " + ", ".join(f"{c} double" for c in cols))
    plain = {r["n"]: r["score"] for r in ranking.clip_scores(df, ["k"]).collect()}
    monkeypatch.setattr(prefix, "SMALL", 0)
    large = {r["n"]: r["score"] for r in ranking.clip_scores(df, ["k"]).collect()}
    assert len(plain) == 800 and plain == {n: None if v is None else pytest.approx(v) for n, v in large.items()}


def test_the_tuning_budget_sorts_what_it_needs_only(spark, monkeypatch):
    from cadenza.operators import prefix
    from cadenza.plans import catalogue

    seen, ranged = [], prefix.ranged
    monkeypatch.setattr(prefix, "SMALL", 0)
    monkeypatch.setattr(prefix, "ranged", lambda df, *more: seen.append(sorted(df.columns)) or ranged(df, *more))
    large = catalogue.tune_budget(spark, "/root/testdata/sf0.001").collect()
    assert seen == [["duration", "part", "take", "voice"]]
    monkeypatch.setattr(prefix, "SMALL", 1 << 40)
    assert sorted(map(tuple, large)) == sorted(map(tuple, catalogue.tune_budget(spark, "/root/testdata/sf0.001").collect()))

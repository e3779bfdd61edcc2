"""Joins of takes, listings, job queues and states, the two-stage shortlist."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import listings, ranking, seams, takes
from cadenza.streaming import ledger as streams

SR = 1000


def burst(before: int, n: int, after: int) -> list[float]:
    return [*[0.0] * before, *(0.5 * np.sin(np.arange(n) * 0.7)).tolist(), *[0.0] * after]


def test_join_trims_edges_and_sizes_gaps(spark):
    parts = [("a", 0, burst(200, 400, 300), "One."), ("a", 1, burst(100, 300, 100), "two,"), ("b", 0, burst(50, 100, 50), "Alone.")]
    df = spark.createDataFrame(parts, "render string, k int, x array<double>, said string")
    rows = {(r.render, r.k): r for r in seams.seams(df, ["render"], "k", "x", "said", SR).collect()}
    assert (rows["a", 0].lo, rows["a", 0].hi, rows["a", 0].gap, rows["a", 0].begin) == (175, 625, 420, 0)
    assert (rows["a", 1].lo, rows["a", 1].hi, rows["a", 1].gap, rows["a", 1].begin) == (75, 425, 0, 870)
    assert (rows["b", 0].lo, rows["b", 0].hi, rows["b", 0].gap) == (0, 200, 0)
    got = {r.render: np.array(r.samples) for r in seams.joined(df, ["render"], "k", "x", "said", SR).collect()}
    assert len(got["a"]) == 450 + 420 + 350
    assert got["b"].tolist() == parts[2][2]
    np.testing.assert_allclose(got["a"][40:400], parts[0][2][215:575], atol=1e-12)
    again = {r.render: r.samples for r in seams.joined(df, ["render"], "k", "x", "said", SR).collect()}
    assert again["a"] == got["a"].tolist()


def test_room_tone_level_and_seed(spark):
    row = spark.range(1).select(
        seams.room_tone(F.lit(4000), F.lit(0.0005), F.lit(1)).alias("a"), seams.room_tone(F.lit(4000), F.lit(0.5), F.lit(2)).alias("b"), seams.room_tone(F.lit(0), F.lit(0.5), F.lit(2)).alias("c")
    ).first()
    level = lambda x: float(np.sqrt(np.mean(np.square(x))))
    assert level(row.a) == pytest.approx(0.0005, rel=1e-6)
    assert level(row.b) == pytest.approx(10 ** (-55 / 20), rel=1e-6)
    assert row.c == []
    a = np.array(row.a)
    assert abs(np.corrcoef(a, row.b)[0, 1]) < 0.1
    power = np.abs(np.fft.rfft(a)) ** 2
    assert power[: len(power) // 4].sum() > 5 * power[-len(power) // 4 :].sum()  # low-passed


def test_queue_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(m, i, int(rng.integers(0, 500)), int(rng.integers(1, 40))) for m in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "machine int, job int, arrive long, took long")
    want, free = {}, {}
    for m, i, at, took in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        begun = max(at, free.get(m, at))
        free[m] = begun + took
        want[m, i] = (begun, free[m])
    assert {(r.machine, r.job): (r.begun, r.finished) for r in listings.queue(df, ["machine"], "arrive", "took", ["job"]).collect()} == want


def test_families_in_order_and_unknown(spark):
    names = lambda *x: spark.createDataFrame([(i, n) for i, n in enumerate(x)], "position int, name string")
    got = listings.families(names("sopro", "qwen3-tts-0.6b", "recommended", "sopro"), takes.engines(spark), gpu=True).orderBy("position", "family").collect()
    assert [r.family for r in got] == ["sopro", "qwen3", "chatterbox"]
    with pytest.raises(Exception, match="unknown engine or family: nope"):
        listings.families(names("nope"), takes.engines(spark), gpu=False).collect()


def test_device_and_lookup(spark):
    df = spark.createDataFrame([("cuda", ["cuda", "cpu"]), (None, ["cuda", "mps", "cpu"]), ("mps", ["cpu"]), (None, ["cuda"])], "want string, allowed array<string>")
    assert [r[0] for r in df.select(listings.device(F.col("want"), F.col("allowed"), ["mps", "cpu"])).collect()] == ["cpu", "mps", "cpu", "cpu"]
    asked = spark.createDataFrame([("x",), ("y",)], "job string")
    jobs = spark.createDataFrame([("x", "failed", "why")], "job string, status string, error string")
    assert sorted(map(tuple, listings.lookup(asked, jobs).collect()), key=str) == [("x", "failed", "why"), ("y", "unknown", None)]


def test_job_states_as_a_stream(spark, tmp_path):
    lines = [(1, 1, "queued", None), (1, 2, "running", None), (1, 4, "running", "late"), (1, 3, "failed", "broke"), (2, 1, "queued", None), (2, 2, "running", None)]
    schema = "job long, seq long, status string, message string"
    for k in range(0, len(lines), 2):
        spark.createDataFrame(lines[k : k + 2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streams.jobs(stream).writeStream.outputMode("complete").format("memory").queryName("job_states_test").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("job_states_test").collect())) == [(1, "failed", "broke", 4), (2, "running", None, 2)]


def test_two_stage_replaces_what_is_screened_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1, 100.0 * i, rng.normal(size=8).tolist(), 0.9 - i / 100, 0.9, 30.0, 120.0, 2.5, 9.0, i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "pos long, source int, start double, emb array<double>, sim double, confidence double, snr_db double, f0_median double, rate_wps double, duration double, clean boolean")
    got = ranking.two_stage(df, ["source"], 3, F.col("clean")).orderBy("chosen").collect()
    # six by similarity are 0..5; 0, 2 and 4 are clean
    assert [(r.pos, r.chosen) for r in got] == [(0, 1), (2, 2), (4, 3)]

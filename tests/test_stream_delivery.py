from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import signal
from cadenza.operators import ingest
from cadenza.sources import delivery

NOW = datetime.datetime(2025, 3, 1)
LEDGER = "voice string, seq long, ts timestamp, status string"
SCHEMA = "id int, voice string, probability double, payload boolean, tags map<string,string>, true_peak double"


def rows_in(spark, path, k, *rows):
    full = [(i, v, p, True, {"comment": delivery.DISCLOSURE}, -2.0) for i, v, p in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{k}")


def run(spark, path, ledger, **more):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = delivery.deliver_stream(stream, ledger, f"{path}/out", f"{path}/state", **more).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def ids(spark, path):
    return sorted(r["id"] for p in path.glob("out/batch-*") for r in spark.read.parquet(str(p)).collect())


def test_a_batch_that_is_played_again_is_delivered_once(spark, tmp_path, monkeypatch):
    ledger = lambda: spark.createDataFrame([("a", 1, NOW, "verified")], LEDGER)
    rows_in(spark, tmp_path, 0, (1, "a", 0.9), (2, "a", 0.9))
    plain = delivery.deliver
    crashes = ["before", "after"]

    def crashing(batch, ledger, target):
        """Once before the rename, with a stage left behind, and once between the rename and the stream's own record."""
        if crashes and crashes[0] == "before":
            crashes.pop(0)
            batch.write.parquet(f"{target}.part-dead")
            raise OSError("lost")
        plain(batch, ledger, target)
        if crashes:
            crashes.pop(0)
            raise OSError("lost")

    monkeypatch.setattr(delivery, "deliver", crashing)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path, ledger)
    assert ids(spark, tmp_path) == [1, 2]
    rows_in(spark, tmp_path, 1, (3, "a", 0.9))
    run(spark, tmp_path, ledger)
    assert ids(spark, tmp_path) == [1, 2, 3] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch-0000000000", "batch-0000000001"]


def test_a_refused_batch_stays_refused(spark, tmp_path):
    standing = {"status": "revoked"}
    ledger = lambda: spark.createDataFrame([("a", 1, NOW, standing["status"])], LEDGER)
    rows_in(spark, tmp_path, 0, (1, "a", 0.9))
    with pytest.raises(Exception, match="consent"):
        run(spark, tmp_path, ledger)
    standing["status"] = "verified"  # a grant that came later doesn't cover it
    with pytest.raises(Exception, match="refused before"):
        run(spark, tmp_path, ledger)
    rows_in(spark, tmp_path, 1, (2, "a", 0.1), (3, "a", 0.9))  # a mark too weak: all of the batch is refused
    rows_in(spark, tmp_path, 2, (4, "a", 0.9))
    run(spark, tmp_path, ledger, keep_on=True)
    assert ids(spark, tmp_path) == [4] and sorted(p.name for p in (tmp_path / "out" / "_refused").iterdir()) == ["0000000000", "0000000001"]


def test_frames_are_made_in_one_crossing(spark):
    sr, t = 8000, np.arange(8000) / 8000
    signals = [(1, (0.4 * np.sin(2 * np.pi * 150 * t)).tolist(), sr), (2, np.random.default_rng(1).normal(0, 0.1, 6000).tolist(), sr), (3, [0.1] * 100, sr), (4, None, sr), (5, [], sr)]
    df = spark.createDataFrame(signals, "id int, x array<double>, sr int").coalesce(1)
    x, p = signal.spectral("x", "sr"), signal.prosody("x", "sr")
    both = df.select("id", x.alias("all"), signal.bandwidth_hz("x", "sr").alias("b"), signal.rolloff_hz("x", "sr").alias("r"), p.alias("p"))
    for r in both.collect():
        assert tuple(r["all"]) == (r["b"], r["r"], *r["p"])
    clip = df.select(ingest.features(F.col("x"), F.col("sr"), F.array(F.lit(1.0)), F.lit(3), F.lit(1.0)).alias("f"))
    plan = clip._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("spectral(") >= 1 and "prosody(" not in plan and "bandwidth_hz(" not in plan
    assert abs(clip.first()["f"]["f0_median"] - 150) < 1

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import consent
from cadenza.sources import files
from cadenza.streaming import ledger as streams

NOW = datetime.datetime(2025, 3, 1, 12)
SCHEMA = "voice string, seq long, ts timestamp, kind string, status string, match double"


def test_history_goes_by_lines_not_by_clocks(spark, tmp_path):
    line = lambda at, status, more="": f'{{"voice": "a", "at": "2025-01-01T00:00:{at:02d}Z", "kind": "attested", "status": "{status}"{more}}}\n'
    (tmp_path / "back").mkdir()
    (tmp_path / "back" / "x.jsonl").write_text(line(5, "attested") + line(3, "revoked"))
    now = consent.current(files.history(spark, f"{tmp_path}/back")).first()
    assert (now["seq"], now["status"], now["usable"]) == (2, "revoked", False)
    # one second, and files that are read in many stretches
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "x.jsonl").write_text("".join(line(7, random.Random(k).choice(["attested", "pending"])) for k in range(3000)) + line(7, "revoked"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        x = files.history(spark, f"{tmp_path}/long")
        assert spark.read.text(f"{tmp_path}/long").rdd.getNumPartitions() > 1 and x.agg(F.count_distinct("seq"), F.max("seq")).first() == (3001, 3001)
        assert [consent.current(x).first()[c] for c in ("seq", "status")] == [3001, "revoked"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "given").mkdir()
    (tmp_path / "given" / "x.jsonl").write_text(line(1, "pending", ', "seq": 1') + line(2, "revoked", ', "seq": 2') + line(9, "attested", ', "seq": 2'))
    x = files.history(spark, f"{tmp_path}/given")
    assert sorted(r["seq"] for r in x.collect()) == [1, 2, 2] and consent.current(x).first()["status"] == "revoked"


def test_equal_seqs_fail_closed(spark):
    at = lambda k: NOW + datetime.timedelta(seconds=k)
    for status, kind, match, want in (("revoked", "attested", None, "revoked"), ("pending", "spoken", None, "pending"), ("verified", "spoken", 0.1, "another speaker"), ("verified", "spoken", 0.9, "")):
        rows = [("a", 1, at(0), "attested", "attested", None), ("a", 2, at(9), "attested", "attested", None), ("a", 2, at(3), kind, status, match)]
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, SCHEMA)
            assert consent.current(df).first()["refusal"] == want
            probes = spark.createDataFrame([("a", at(0), 1), ("a", at(3), 2), ("a", at(20), 3)], "voice string, at timestamp, probe long")
            got = {r["probe"]: r["in_force"] for r in consent.as_of(df, probes).collect()}
            assert got[1] == "attested" and got[2] == status and (got[3] == status or want == "")


def test_of_two_writers_one_wins(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ask = lambda voice: spark.createDataFrame([(voice, NOW, "Ann", "Bo", "letter", "", False)], "voice string, now timestamp, speaker string, by string, evidence string, scope string, override boolean")
    take_back = lambda voice: spark.createDataFrame([(voice, NOW)], "voice string, now timestamp")
    consent.append(consent.attested(ask("a"), spark.createDataFrame([], SCHEMA)), path)
    seen = consent.ledger(spark, path).persist()
    assert seen.count() == 1
    one, two, other = consent.revoked(take_back("a"), seen), consent.attested(ask("a"), seen), consent.attested(ask("b"), seen)
    consent.append(one, path)
    with pytest.raises(consent.LedgerConflict, match="'a'"):
        consent.append(two, path)  # made before the revocation was seen
    consent.append(other, path)  # another voice is no conflict
    now = {r["voice"]: r["usable"] for r in consent.current(consent.ledger(spark, path)).collect()}
    assert now == {"a": False, "b": True}
    with pytest.raises(consent.LedgerConflict, match="one append"):
        consent.append(consent.attested(ask("c").union(ask("c")), consent.ledger(spark, path)), path)
    assert sorted(p.name for p in (tmp_path / "ledger").iterdir() if not p.name.startswith(".")) == [f"commit-{k:010d}" for k in (1, 2, 3)]
    seen.unpersist()


def test_a_number_that_is_taken_is_never_replaced(spark, tmp_path, monkeypatch):
    """The other writer takes the number between the look at the ledger and the rename."""
    path, ask = f"{tmp_path}/ledger", "voice string, now timestamp, speaker string, by string, evidence string, scope string, override boolean"
    empty = spark.createDataFrame([], SCHEMA)
    rows = lambda v: consent.attested(spark.createDataFrame([(v, NOW, "Ann", "Bo", "letter", "", False)], ask), empty)
    plain, late = consent._renamed, []

    def overtaken(spark, source, target, fs, owner):
        if not late:
            late.append(1)
            consent.append(rows(other), path)
        return plain(spark, source, target, fs, owner)

    for other, n in (("b", 2), ("a", 1)):
        late.clear()
        monkeypatch.setattr(consent, "_renamed", overtaken)
        path = f"{tmp_path}/ledger-{other}"
        if other == "a":
            with pytest.raises(consent.LedgerConflict):
                consent.append(rows("a"), path)
        else:
            consent.append(rows("a"), path)
        assert consent.ledger(spark, path).count() == n


def test_stream_takes_the_stricter_of_equal_seqs(spark, tmp_path):
    rows = [("a", 1, "attested"), ("a", 2, "attested"), ("a", 2, "revoked"), ("b", 2, "revoked"), ("b", 2, "attested"), ("b", 1, "attested")]
    schema = "voice string, seq long, status string"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = streams.states(stream).writeStream.format("memory").queryName("ledger_ties").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [(r["voice"], r["status"]) for r in spark.table("ledger_ties").collect()]
    # whatever the order of arrival, nothing usable follows a revocation
    for v in "ab":
        mine = [s for w, s in got if w == v]
        assert mine[-1] == "revoked" and "attested" not in mine[mine.index("revoked") :]

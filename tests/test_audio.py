from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, Not

from cadenza.functions import providers
from cadenza.sources import audio, blobs


def wav(samples, sr=100, kind=1, bits=16, channels=1, before=b"", extensible=False):
    dtype = {(1, 16): "<i2", (1, 8): "u1", (1, 32): "<i4", (3, 32): "<f4"}[kind, bits]
    body = np.repeat(samples, channels).astype(dtype).tobytes()
    width = channels * bits // 8
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, sr, sr * width, width, bits)
    form += struct.pack("<HHIH14s", 22, bits, 0, kind, b"\0" * 14) if extensible else b""
    chunks = before + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("wav")
    rng = np.random.default_rng(1)
    held = {}
    for name, n, more in (("long.wav", 60_000, {}), ("b.WAV", 250, {"channels": 2}), ("c.wav", 99, {"before": b"LIST" + struct.pack("<I", 5) + b"12345\0"}), ("d.wav", 300, {"extensible": True}), ("e.wav", 0, {})):
        x = rng.integers(-32768, 32767, n)
        (path / name).write_bytes(wav(x, **more))
        held[str(path / name)] = x / 32768
    (path / "note.txt").write_text("none")
    (path / "_part.wav").write_bytes(b"half")
    return path, held


def test_windows_hold_all_samples(spark, folder):
    path, held = folder
    for seconds, split in ((1.0, 1 << 20), (0.73, 5000)):
        got = audio.windows(spark, str(path), seconds, split).orderBy("path", "window").collect()
        each = round(seconds * 100)
        for name, x in held.items():
            mine = [r for r in got if r["path"] == name]
            assert [r["window"] for r in mine] == list(range(-(-len(x) // each)))
            assert np.allclose(np.concatenate([r["samples"] for r in mine] or [[]]), x, atol=1e-7)
            assert all(r["begin"] == pytest.approx(r["window"] * seconds) and r["seconds"] == len(r["samples"]) / 100 for r in mine)


def test_filters_are_pushed_and_only_their_bytes_are_read(spark, folder):
    path, held = folder
    name = str(path / "long.wav")
    reader = audio.Wav({"path": str(path), "window": "1.0", "split": "20000"}).reader(None)
    odd = Not(EqualTo(("path",), "x"))
    rest = list(reader.pushFilters([In(("path",), (name, "other")), GreaterThanOrEqual(("begin",), 100.0), LessThan(("begin",), 103.0), odd, EqualTo(("sr",), 100)]))
    assert rest == [odd, EqualTo(("sr",), 100)]  # what is left to Spark
    parts = reader.partitions()
    assert {p.path for p in parts} == {name} and len(parts) == 7  # 120 kB in stretches of 20 kB
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[2] for r in rows] == [100, 101, 102] and np.allclose(np.concatenate([r[5] for r in rows]), held[name][10_000:10_300], atol=1e-7)
    assert 600 <= reader.taken <= 600 + 7 * 60  # three seconds, and the head once a task
    x = audio.windows(spark, str(path), 1.0).where(F.col("path").isin(name, "y") & (F.col("begin") >= 100.0) & (F.col("begin") < 103.0))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "cadenza_wav" in plan and "Filter" not in plan.replace("RuntimeFilters", ""), plan  # none is left above the scan
    assert [r["window"] for r in x.orderBy("window").collect()] == [100, 101, 102]


def test_stretches_read_what_is_asked_for(spark, folder, monkeypatch):
    path, held = folder
    name, other = str(path / "long.wav"), str(path / "d.wav")
    rows = [(1, name, 5.0, 2.5), (2, name, 599.0, 50.0), (3, other, 0.0, None), (4, other, 900.0, 1.0), (5, None, 1.0, 1.0), (6, name, None, 0.1)]
    got = {r["id"]: r for r in audio.stretches(spark.createDataFrame(rows, "id int, path string, begin double, seconds double").coalesce(1)).collect()}
    for k, want in ((1, held[name][500:750]), (2, held[name][59_900:]), (3, held[other]), (4, []), (6, held[name][:10])):
        assert np.allclose(got[k]["samples"], want, atol=1e-7) and got[k]["sr"] == 100
    assert got[5]["samples"] is None and got[5]["sr"] is None
    read = audio.Reading(*blobs.opened(name))
    x = audio.samples_at(read, providers.layout(read, read.size), 500, 750)
    assert len(x) == 250 and read.taken < 500 + 60
    raw = (path / "long.wav").read_bytes()
    assert np.allclose(providers.parsed_wav(raw, 5.0, 2.5)[0], x)
    for bad in (b"", b"RIFFxxxxWAVE", wav([1])[:20], b"RIFF\0\0\0\0WAVEdata\0\0\0\0"):
        with pytest.raises((ValueError, struct.error)):
            providers.parsed_wav(bad)


def test_written_recordings_come_back(spark, tmp_path):
    rows = [(f"v{k % 2}/{k}.wav", [k / 10, -1.5, 2.0, 0.5], 8000 + k) for k in range(9)]
    df = spark.createDataFrame(rows, "name string, x array<double>, sr int").repartition(4)
    audio.write_wav(df, F.col("name"), F.col("x"), F.col("sr"), f"{tmp_path}/out")
    got = {r["path"].split("/out/")[1]: r for r in audio.windows(spark, f"{tmp_path}/out").collect()}
    assert {(n, sr) for n, _, sr in rows} == {(n, r["sr"]) for n, r in got.items()}
    assert all(np.allclose(got[n]["samples"], np.clip(x, -1, 1), atol=1e-4) for n, x, _ in rows)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="FileExists"):
        audio.write_wav(df, F.col("name"), F.col("x"), F.col("sr"), f"{tmp_path}/out")
    assert len(list((tmp_path / "out").rglob("*.wav"))) == 9


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.format_string("%d.bin", "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        blobs.write_files(rows, F.col("name"), F.col("content"), f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []
    for name in (None, "", "../up", "/root", "_hidden", "a/../../b"):
        bad = spark.createDataFrame([(name, b"x")], "name string, content binary")
        with pytest.raises(Exception, match="not a file"):
            blobs.write_files(bad, F.col("name"), F.col("content"), f"{tmp_path}/out")
    twice = spark.createDataFrame([("a", b"x"), ("a", b"y")], "name string, content binary")
    with pytest.raises(Exception, match="same file name"):
        blobs.write_files(twice, F.col("name"), F.col("content"), f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []
    blobs.write_files(twice.where("false"), F.col("name"), F.col("content"), f"{tmp_path}/out")
    assert blobs.read_files(spark, f"{tmp_path}/out").count() == 0


def test_a_retried_task_leaves_no_double(tmp_path):
    """Two attempts of one task write; the driver is told of one, as Spark does it."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField, StructType, StringType

    writer = blobs.FilesWriter(f"{tmp_path}/out", StructType([StructField("name", StringType()), StructField("content", BinaryType())]))
    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array([n for n, _ in x]), pa.array([c for _, c in x], pa.binary())], names=["name", "content"])
    writer.write(iter([batch(("a", b"first"), ("b", b"lost"))]))  # the attempt whose executor is lost
    again = writer.write(iter([batch(("a", b"second"), ("b", b"kept"))]))
    other = writer.write(iter([batch(("c", b""))]))
    assert not (tmp_path / "out").exists()
    writer.commit([again, None, other])
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a": b"second", "b": b"kept", "c": b""} and [p.name for p in tmp_path.iterdir()] == ["out"]
    aborted = blobs.FilesWriter(f"{tmp_path}/none", StructType([StructField("name", StringType()), StructField("content", BinaryType())]))
    aborted.abort([aborted.write(iter([batch(("a", b"x"))]))])
    assert [p.name for p in tmp_path.iterdir()] == ["out"]

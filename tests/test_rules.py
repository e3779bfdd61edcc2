"""Consent records, choices, fail-closed renders, entities, providers and the ingest plan, against literals and plain Python."""

from __future__ import annotations

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import providers, scalars
from cadenza.operators import consent, entities, ingest, listings, reports, takes
from cadenza.plans import flows
from cadenza.sources import delivery, files
from cadenza.streaming import ledger as streams

NOW = datetime.datetime(2025, 3, 1, 12)
LEDGER = "voice string, seq long, ts timestamp, kind string, status string, match double, created timestamp, expires timestamp"


def record(voice, seq, status, kind="spoken", match=None, day=1, expires=None):
    at = datetime.datetime(2025, 1, day)
    return (voice, seq, at, kind, status, match, at, expires)


def by_voice(df):
    return {r["voice"]: r for r in df.collect()}


def test_a_spoken_consent_of_another_voice_permits_nothing(spark, tmp_path):
    rows = [record("low", 1, "verified", match=0.44), record("high", 1, "verified", match=0.45), record("unknown", 1, "verified"), record("told", 1, "attested", "attested", 0.1), record("open", 1, "pending"), record("gone", 1, "attested", "attested"), record("gone", 2, "revoked", "attested", day=2)]
    ledger = spark.createDataFrame(rows, LEDGER)
    now = by_voice(consent.current(ledger))
    assert {v: r["usable"] for v, r in now.items()} == {"low": False, "high": True, "unknown": True, "told": True, "open": False, "gone": False}
    assert {v: r["refusal"] for v, r in now.items() if not r["usable"]} == {"low": "another speaker", "open": "pending", "gone": "revoked"}
    asked = spark.createDataFrame([(v,) for v in (*now, "nobody")], "voice string")
    assert sorted(r["voice"] for r in consent.permitted(asked, ledger).collect()) == ["high", "told", "unknown"]
    todo = by_voice(consent.steps(asked.withColumn("speaker", F.lit("Ann")), ledger))
    assert {v: len(r["steps"]) for v, r in todo.items() if r["steps"]} == {"low": 4, "open": 4, "gone": 4, "nobody": 4} and todo["nobody"]["consent"] == "none"
    batch = spark.createDataFrame([("low", 0.9, True, {"comment": delivery.DISCLOSURE}, -2.0)], "voice string, probability double, payload boolean, tags map<string,string>, true_peak double")
    with pytest.raises(PermissionError):
        delivery.deliver(batch, lambda: ledger, f"{tmp_path}/out")
    delivery.deliver(batch.withColumn("voice", F.lit("high")), lambda: ledger, f"{tmp_path}/out")


def test_work_is_delivered_under_the_grant_it_began_with(spark, tmp_path):
    old = spark.createDataFrame([record("a", 1, "verified"), record("b", 1, "verified"), record("c", 1, "verified"), record("d", 1, "verified")], LEDGER)
    began = consent.current(old).select("voice", "kind", "created").unionByName(spark.createDataFrame([("e", None, None)], "voice string, kind string, created timestamp"))
    new = old.unionByName(spark.createDataFrame([record("b", 2, "verified", day=5), record("c", 2, "attested", "attested"), record("d", 2, "revoked", day=3)], LEDGER))
    assert {v: r["problem"] for v, r in by_voice(consent.unchanged(began, new)).items()} == {"a": "", "b": "consent changed", "c": "consent changed", "d": "revoked", "e": "missing"}
    batch = began.withColumns({"probability": F.lit(0.9), "payload": F.lit(True), "tags": F.create_map(F.lit("description"), F.lit(delivery.DISCLOSURE)), "true_peak": F.lit(-2.0)})
    with pytest.raises(PermissionError, match="consent changed"):
        delivery.deliver(batch.where("voice IN ('a', 'b')"), lambda: new, f"{tmp_path}/out")
    delivery.deliver(batch.where("voice = 'a'"), lambda: new, f"{tmp_path}/out")


def test_records_are_appended_and_never_lost(spark, tmp_path):
    path, schema = f"{tmp_path}/ledger", "voice string, speaker string, now timestamp, code string, scope string"
    empty = spark.createDataFrame([], LEDGER)
    asked = spark.createDataFrame([("a", "Ann", NOW, "reef amber 12", "all")], schema)
    consent.append(consent.requested(asked, empty), path)
    ledger = lambda: consent.ledger(spark, path)
    first = ledger().first()
    assert (first["seq"], first["status"], first["kind"]) == (1, "pending", "spoken") and first["expires"] == NOW + datetime.timedelta(days=14) and "reef amber 12" in first["statement"] and "Ann" in first["statement"]

    def heard(days=1, seconds=6.0, code=0.0, statement=0.1, match=None):
        rows = [("a", NOW + datetime.timedelta(days=days), seconds, code, statement, match)]
        return consent.verified(spark.createDataFrame(rows, "voice string, now timestamp, seconds double, code_cer double, statement_cer double, match double"), ledger())

    for kw, why in (({"days": 15}, "code expired"), ({"seconds": 3.9}, "too short"), ({"code": 0.3}, "code not heard"), ({"statement": 0.21}, "statement not heard")):
        out = heard(**kw)
        assert out.first()["reason"] == why and consent.appendable(out).count() == 0
    consent.append(heard(match=0.2), path)
    now = consent.current(ledger()).first()
    assert (now["seq"], now["status"], now["match"], now["usable"]) == (2, "pending", 0.2, False)
    consent.append(heard(match=0.8), path)
    assert consent.current(ledger()).first()["usable"]
    consent.append(consent.matched(spark.createDataFrame([("a", NOW, 0.31234)], "voice string, now timestamp, match double"), ledger()), path)
    now = consent.current(ledger()).first()
    assert (now["seq"], now["status"], now["match"], now["refusal"]) == (4, "verified", 0.3123, "another speaker")
    consent.append(consent.revoked(spark.createDataFrame([("a", NOW), ("b", NOW)], "voice string, now timestamp"), ledger()), path)
    now = consent.current(ledger()).first()
    assert (now["status"], now["revoked_at"], ledger().count()) == ("revoked", NOW, 5)
    assert heard().first()["reason"] == "request first"

    def told(by, evidence, override):
        return consent.attested(spark.createDataFrame([("a", NOW, "Ann", by, evidence, "", override)], "voice string, now timestamp, speaker string, by string, evidence string, scope string, override boolean"), ledger())

    assert [told(*x).first()["reason"] for x in ((" ", "letter", True), ("Bo", None, True), ("Bo", "letter", False))] == ["name missing", "evidence missing", "revoked before"]
    consent.append(told("Bo", "letter", True), path)
    now = consent.current(ledger()).first()
    assert (now["seq"], now["status"], now["kind"], now["attested_by"], now["usable"]) == (6, "attested", "attested", "Bo", True)
    assert [r["status"] for r in ledger().orderBy("seq").collect()] == ["pending", "pending", "verified", "verified", "revoked", "attested"]


def test_disclosure_in_either_tag_and_documents(spark, tmp_path):
    tags = [{"comment": delivery.DISCLOSURE}, {"description": f"x {delivery.DISCLOSURE}"}, {"title": delivery.DISCLOSURE}, {}, None]
    df = spark.createDataFrame([(t,) for t in tags], "t map<string,string>").coalesce(1)
    assert [r[0] for r in df.select(delivery.tags_ok(F.col("t"))).collect()] == [True, True, False, False, False]
    made = spark.range(1).select(delivery.disclosure_tags(F.lit("v"), F.lit("Ann"), F.lit("spoken"), F.lit("e")).alias("t")).first()["t"]
    assert "Ann" in made["comment"] and "spoken consent" in made["comment"] and made["cadenza_consent"] == "spoken" and len(made) == 9
    rows = spark.createDataFrame([(1, 2, True), (1, 1, False)], "part int, take int, ok boolean")
    out = delivery.manifest(rows, ["part"], ["ok"], "take", F.lit(NOW))
    assert out.first()["json"] == '{"generator":"cadenza","created":"2025-03-01T12:00:00Z","part":1,"attempts":[{"take":1,"ok":false},{"take":2,"ok":true}]}'
    for _ in range(2):
        delivery.write_documents(out, f"{tmp_path}/m")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/m").collect()] == [out.first()["json"]] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["m"]
    assert delivery.checked_format("flac") == "flac"
    with pytest.raises(ValueError):
        delivery.checked_format("aiff")


def test_parts_are_combined_by_weight(spark):
    schema = "render int, part int, w double, q double, cer double, wer double, duration double, longest_pause double, ok boolean, reason string, transcript string"
    rows = [(1, 2, 3.0, 0.9, 0.0, 0.1, 3.0, 0.5, True, "", "b c"), (1, 1, 1.0, 0.5, 0.2, 0.3, 1.0, 0.7, False, "clipping", "a"), (1, 3, 0.0, 0.1, 0.0, 0.0, 0.0, 0.0, True, "note", "d"), (2, 1, 0.0, 0.7, 0.1, 0.2, 2.0, 0.1, True, "", "x"), (3, 1, 0.0, 0.4, 0.0, 0.0, 1.0, 0.0, True, "", "y"), (3, 2, 0.0, 0.8, 0.0, 0.0, 1.0, 0.0, False, "dead air", "z")]
    got = {r["render"]: r for r in takes.combine(spark.createDataFrame(rows, schema), ["render"], "part", "w").collect()}
    assert got[1]["q"] == pytest.approx(0.8) and got[1]["wer"] == pytest.approx(0.15) and (got[1]["duration"], got[1]["longest_pause"], got[1]["ok"], got[1]["reason"], got[1]["transcript"]) == (4.0, 0.7, False, "clipping", "a b c d")
    assert (got[2]["q"], got[2]["ok"], got[2]["transcript"]) == (0.7, True, "x") and got[3]["q"] == pytest.approx(0.6) and got[3]["reason"] == "dead air"


def test_a_render_stops_at_a_part_that_never_passes(spark):
    rows = [(1, 1, True, 0.5, ""), (2, 1, False, 0.4, "clipping"), (2, 2, False, 0.6, "dead air"), (3, 1, False, 0.2, "cut off")]
    chosen = takes.best_of(spark.createDataFrame(rows, "part int, take int, ok boolean, q double, reason string"), takes.PRESETS[0]).withColumn("render", F.lit(7))
    assert takes.fail_closed(chosen, ["render"]).first().asDict() == {"render": 7, "n_parts": 3, "ok": False, "problem": "part 2 never passed the checks (last problem: dead air)"}
    with pytest.raises(takes.NeverPassed, match="part 2"):
        takes.require_passed(chosen, ["render"])
    assert takes.require_passed(chosen, ["render"], allow_imperfect=True).count() == 3 and takes.require_passed(chosen.where("ok"), ["render"]).count() == 1


def test_polished_twins_replace_what_they_beat(spark):
    rows = [(1, 1, True, 0.6, False), (1, 1, True, 0.7, True), (1, 2, True, 0.65, False), (1, 2, False, 0.9, True), (2, 1, False, 0.3, False), (2, 1, True, 0.9, True)]
    x = takes.with_twins(spark.createDataFrame(rows, "part int, take int, ok boolean, q double, polished boolean"))
    assert sorted((r["part"], r["take"], r["ok"], r["q"], r["passes"]) for r in x.collect()) == [(1, 1, True, 0.7, 2), (1, 2, True, 0.65, 1), (2, 1, False, 0.3, 1)]
    assert takes.best_of(x, takes.PRESETS[0]).where("part = 1").first()["consumed"] == 1  # both twins of the first take count as passed


def test_engines_and_probes(spark):
    dimension = takes.engines(spark)
    with pytest.raises(KeyError, match="known: chatterbox-multilingual, .*sopro"):
        takes.engine(dimension, "nope")
    none = spark.createDataFrame([], "family string")
    assert [r["engine"] for r in takes.asked_candidates(dimension, none, "xx", "cpu", ["sopro"]).collect()] == ["sopro"]
    voices = spark.createDataFrame([("e", "en"), ("d", "de"), ("n", "de")], "voice string, language string")
    refs = spark.createDataFrame([("d", "r1", 0.9, "eins"), ("d", "r2", 0.1, "zwei"), ("d", "r3", 0.5, "drei")], "voice string, reference string, score double, text string")
    said = spark.createDataFrame([("en", 1, "one"), ("en", 2, "two"), ("en", 3, "three")], "language string, place int, text string")
    got = sorted(map(tuple, takes.probes(voices, refs, said, 2).collect()))
    assert got == [("d", 1, "zwei"), ("d", 2, "drei"), ("e", 1, "one"), ("e", 2, "two"), ("n", 1, "one"), ("n", 2, "two")]


def test_entities_and_outputs(spark):
    voices = spark.createDataFrame([("old",)], "voice string")
    asked = spark.createDataFrame([("new", "A", None, 1), ("new", "B", "de", 2), ("old", "C", None, 1), ("Bad", "D", None, 1), ("ok\n", "E", None, 1), ("a" * 64, "F", None, 1)], "voice string, speaker string, language string, now int")
    got = {(r["voice"], r["speaker"]): (r["problem"], r["language"]) for r in entities.created(asked, voices).collect()}
    assert got == {("new", "A"): ("", "en"), ("new", "B"): ("already exists", "de"), ("old", "C"): ("already exists", "en"), ("Bad", "D"): ("bad name", "en"), ("ok\n", "E"): ("", "en"), ("a" * 64, "F"): ("bad name", "en")}
    refs = spark.createDataFrame([("old", "ref01", "refs/ref01.wav"), ("x", "ref01", "refs/ref01.wav")], "voice string, id string, path string")
    assert [r["voice"] for r in entities.deleted({"references": refs}, voices)["references"].collect()] == ["x"]
    assert entities.reference(refs, "x", "ref01").select(entities.reference_path("/v/", F.col("voice"), F.col("path"))).first()[0] == "/v/x/refs/ref01.wav"
    with pytest.raises(KeyError):
        entities.reference(refs, "x", "ref02")
    paths = {"a.wav": "", "sub/b.MP3": "", "../c.wav": "outside the outputs folder", "/out/../outer/d.wav": "outside the outputs folder", "e.txt": "unknown ending", ".wav": "unknown ending", "there.wav": "already exists", "noted.ogg": "already exists", "/out/x/./f.flac": ""}
    old = spark.createDataFrame([("/out/there.wav",), ("/out/noted.cadenza.json",)], "path string")
    df = spark.createDataFrame([(p, p) for p in paths], "asked string, path string")
    assert {r["asked"]: r["problem"] for r in entities.agent_outputs(df, "/out", old).collect()} == paths
    got = {r["asked"]: r["problem"] for r in entities.guarded(spark.createDataFrame([(p, p) for p in ("/v/x.wav", "/v2/x.wav", "y/../../v/z.wav")], "asked string, path string"), ["/v"], "/out").collect()}
    assert got == {"/v/x.wav": "protected folder", "/v2/x.wav": "", "y/../../v/z.wav": "protected folder"}
    names = spark.range(1).select(entities.manifest_name(F.lit("/o/a.b.wav")), entities.default_output("/o", F.lit("v"), F.lit(NOW), "wav"), scalars.moment(F.lit(NOW))).first()
    assert tuple(names) == ("/o/a.b.cadenza.json", "/o/v-20250301-120000.wav", "2025-03-01T12:00:00Z")
    models = entities.model_status(spark.createDataFrame([("a", "A", 123_456_789), ("b", "B", 5)], "key string, name string, size long"), spark.createDataFrame([("a", 5)], "key string, length long"))
    assert sorted(map(tuple, models.collect())) == [("a", "A", True, 123.5), ("b", "B", False, 0.0)]


def test_small_rules(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(scalars.loudness_gain(F.lit(-20.0), F.lit(-3.0)), scalars.loudness_gain(F.lit(-30.0), F.lit(-20.0)), scalars.loudness_gain(F.lit(float("-inf")), F.lit(-20.0))) == (1.5, 14.0, None)
    tuned, asked = F.create_map(F.lit("language"), F.lit("de"), F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))
    assert one(scalars.options(F.lit("en"), tuned, F.lit(True), asked), scalars.options(F.lit("en"), tuned, F.lit(False), F.lit(None).cast("map<string,string>"))) == ({"language": "de", "a": "2"}, {"language": "en"})
    assert one(scalars.log_tail(F.array(*map(F.lit, range(9)))), scalars.log_tail(F.array(F.lit(1)))) == ([3, 4, 5, 6, 7, 8], [1])
    assert len(one(scalars.fingerprint(F.array(F.lit("a"), F.lit("b"))))[0]) == 16
    x = spark.createDataFrame([(" V..... libopus  Opus\n A..... aac ", " .. ebur128 A->N ")], "e string, f string").select(files.capabilities(F.col("e"), F.col("f")).alias("c")).first()["c"]
    assert x.asDict() == {"libmp3lame": False, "aac": True, "libopus": True, "flac": False, "ebur128": True}


def test_bench_cases_by_speaker(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [("s", f"u{i:02d}", words(n), d) for i, (n, d) in enumerate([(15, 5.0), (12, 10.0), (31, 11.0), (30, 4.0), (11, 4.0), (12, 3.0)])] + [("t", "u00", words(15), 20.0)]
    got = {r["id"]: r["role"] for r in reports.cases(spark.createDataFrame(rows, "speaker string, id string, text string, duration double")).collect()}
    assert got == {"u00": "target", "u01": "reference", "u02": "holdout", "u03": "target", "u04": "holdout", "u05": "holdout"}


def test_providers(spark):
    providers.register("embedding", "mean", lambda: lambda x, sr: [float(np.mean(x)), float(len(x)) / sr])
    providers.register("transcript", "count", lambda: lambda x, sr: {"text": f"{len(x)}", "words": [{"text": "a", "start": 0.0, "end": 0.1, "logprob": -0.5}]})
    providers.register("events", "loud", lambda: lambda x, sr: {"Noise": float(np.max(x))})
    df = spark.createDataFrame([([0.5] * 5, 10), ([1.0] * 20, 10), (None, 10)], "x array<double>, sr int").coalesce(1)
    got = df.select(providers.embedded("mean", F.col("x"), F.col("sr")).alias("e"), providers.column("transcript", "count", F.col("x"), F.col("sr")).alias("t"), providers.column("events", "loud", F.col("x"), F.col("sr")).alias("m")).collect()
    a = np.array([0.25, 1.0])
    assert got[0]["e"] == pytest.approx(a / np.linalg.norm(a)) and got[1]["t"]["text"] == "20" and got[1]["t"]["words"][0]["end"] == 0.1 and got[0]["m"] == {"Noise": 0.5} and got[2]["e"] is None and got[2]["t"] is None
    for kind, name in (("embedding", "nope"), ("nothing", "x")):
        with pytest.raises(providers.UnknownProvider):
            providers.column(kind, name, F.col("x"))
    mark = lambda p, k: F.struct(F.lit(p).alias("probability"), F.lit(k).alias("payload"))
    assert tuple(spark.range(1).select(*[providers.marked_ok(mark(*m)) for m in ((0.5, 0x5653), (0.49, 0x5653), (0.9, 1))], providers.token_cap(F.lit(16))).first()) == (True, False, False, 352)


def test_wav_files_round_trip_and_are_read_in_part(spark):
    x = np.sin(np.arange(4000) / 20) * 1.2
    raw = spark.createDataFrame([(x.tolist(), 1000)], "x array<double>, sr int").select(providers.wav_bytes("x", "sr")).first()[0]
    y, sr = providers.parsed_wav(bytes(raw))
    assert sr == 1000 and np.abs(y - np.clip(x, -1, 1) * 32767 / 32768).max() < 1e-4
    part = spark.createDataFrame([(bytearray(raw), 1.0, 0.5)], "c binary, b double, s double").select(providers.read_wav(F.col("c"), F.col("b"), F.col("s")).alias("w"), providers.read_wav(F.col("c")).alias("v")).first()
    assert part["w"]["samples"] == pytest.approx(y[1000:1500]) and len(part["v"]["samples"]) == 4000
    for bits, kind, body in ((24, 1, b"\x00\x00\x40\x00\x00\xc0"), (8, 1, bytes([192, 64])), (32, 3, struct.pack("<2f", 0.5, -0.5)), (32, 1, struct.pack("<2i", 1 << 30, -(1 << 30)))):
        head = struct.pack("<4sI4s4sIHHIIHH4sI4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, kind, 2, 8000, 0, bits // 4, bits, b"LIST", 0, b"data", len(body))
        assert providers.parsed_wav(head + body)[0].tolist() == [0.0]  # the two channels cancel out
    with pytest.raises(ValueError):
        providers.parsed_wav(b"nothing")


def test_ingest_plan(spark):
    rng = np.random.default_rng(2)
    base = np.linalg.qr(rng.normal(size=(16, 2)))[0].T

    def unit(v):
        return (v / np.linalg.norm(v)).tolist()

    rows = []
    for i in range(60):
        mine = i % 4 > 0
        rows.append(("v", f"s{i % 3}.wav", 70.0 * i, 1.0 if i == 1 else 8.0 + i % 5, unit(base[0 if mine else 1] + 0.1 * rng.normal(size=16)), 0.5 if i == 2 else 0.0, 20.0 + i % 7, 7000.0))
    regions = spark.createDataFrame(rows, "voice string, source string, start double, duration double, emb array<double>, clipping double, snr_db double, bandwidth double")
    targets = spark.createDataFrame([("v", base[0].tolist())], "voice string, target array<double>")
    clips = lambda r: r.select("voice", "source", "start", "duration", "emb", "clipping", "snr_db", "bandwidth", F.concat(F.lit("text "), "start").alias("text"), F.when(F.col("start") == 210.0, 0.3).otherwise(0.9).alias("confidence"), (120 + F.col("start") % 9).alias("f0_median"), F.lit(3.0).alias("f0_range_st"), (2.5 + F.col("start") % 4 / 10).alias("rate_wps"))
    events = lambda g: F.when(F.col("start") % 4 == 0, F.create_map(F.lit("Music"), F.lit(0.9))).otherwise(F.create_map(F.lit("Speech"), F.lit(0.9)))
    out = ingest.run(regions, clips, targets, events, k=5)
    refs = out["references"].orderBy("id").collect()
    # ten are shortlisted, and what is contaminated among them is not made up for
    assert [r["id"] for r in refs] == [f"ref{i:02d}" for i in range(1, len(refs) + 1)] and 3 <= len(refs) <= 5 and len(refs[0]) == 12
    kept = {r[2] for k, r in enumerate(rows) if k % 4 > 0 and k not in (1, 2)}
    assert all(r["start"] in kept and r["start"] % 4 != 0 and r["start"] != 210.0 for r in refs)
    assert [(r["reason"], r["n"]) for r in out["rejected"].collect()] == [("unclear speech", 1)]
    v, stats = out["vectors"].first(), out["stats"].first()
    assert v["holdout"] != v["centroid"] and np.dot(v["centroid"], base[0]) > 0.95
    assert stats["clean_clips"] == len(kept) - 1 and stats["self_similarity"] > 0.8
    with pytest.raises(ingest.NothingLeft, match="no speech"):
        ingest.run(regions.where("false"), clips, targets, events)
    x = spark.range(1).select(ingest.reference_window(F.lit(0.1), F.lit(5.0)).alias("w"), ingest.reference_signal(F.array_repeat(F.lit(0.001), 4000), 1000).alias("x")).first()
    assert (x["w"]["begin"], round(x["w"]["seconds"], 2)) == (0.0, 5.45) and 20 * np.log10(np.sqrt(np.mean(np.square(x["x"])))) == pytest.approx(-23, abs=0.01)


def test_ledger_stream_tells_transitions(spark, tmp_path):
    rows = [("a", 1, "pending"), ("a", 3, "revoked"), ("a", 2, "verified"), ("b", 1, "attested")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "voice string, seq long, status string").coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("voice string, seq long, status string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = streams.states(stream).writeStream.format("memory").queryName("ledger_changes").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["voice"], r["seq"], r["status"], r["previous"], r["changed"]) for r in spark.table("ledger_changes").collect()}
    assert ("b", 1, "attested", "", True) in got and max(r for r in got if r[0] == "a")[:3] == ("a", 3, "revoked")


def test_bank_rewrites_only_the_voices_given(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "voice string, id string")
    delivery.write_bank(rows(("a", "ref01"), ("a", "ref02"), ("b", "ref01")), f"{tmp_path}/bank")
    delivery.write_bank(rows(("a", "ref09")), f"{tmp_path}/bank")
    assert sorted((r["voice"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/bank").collect()) == [("a", "ref09"), ("b", "ref01")]


def test_listings_of_gpus_sidecars_histories_and_vectors(spark, tmp_path):
    got = spark.range(1).select(listings.gpus(F.lit("Card A, 24576\nCard B, [N/A]\nnothing")).alias("g")).first()["g"]
    assert [tuple(x) for x in got] == [("Card A", 24.0), ("Card B", None)]
    names = spark.createDataFrame([("a.ogg",), ("b.ogg",)], "name string")
    sides = spark.createDataFrame([("a", '{"title": "T", "duration": 3.5, "other": 1}')], "stem string, json string")
    assert {r["name"]: (r["title"], r["duration"]) for r in files.with_sidecars(names, sides).collect()} == {"a.ogg": ("T", 3.5), "b.ogg": (None, None)}
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.jsonl").write_text('{"voice": "a", "at": "2025-01-01T00:00:00Z", "kind": "spoken", "status": "pending"}\n{"voice": "a", "at": "2025-01-02T00:00:00Z", "kind": "spoken", "status": "verified", "speaker_match": 0.3}\n')
    now = consent.current(files.history(spark, f"{tmp_path}/h")).first()
    assert (now["seq"], now["status"], now["refusal"]) == (2, "verified", "another speaker")
    spark.createDataFrame([("a", [1.0], None), ("b", [2.0], [3.0])], "voice string, centroid array<float>, holdout array<float>").write.parquet(f"{tmp_path}/v")
    assert {r["voice"]: (r["holdout"], r["anchor"]) for r in files.centroid_rows(spark, f"{tmp_path}/v").collect()} == {"a": ([1.0], None), "b": ([3.0], None)}
    (tmp_path / "t.txt").write_text("k1 HELLO THERE\n\nk2 x\n")
    assert sorted(map(tuple, files.transcripts(spark, f"{tmp_path}/t.txt").collect())) == [("k1", "Hello there"), ("k2", "X")]
    log = "x\nSummary:\n I: -9.0 LUFS\nSummary:\n\n  I:         -23.4 LUFS\n  LRA: 1.0 LU\n  Peak:       -inf dBFS"
    x = spark.range(1).select(files.loudness(F.lit(log)).alias("l")).first()["l"]
    assert (x["integrated"], x["true_peak"]) == (-23.4, float("-inf"))


def test_entities_read_strictly_or_leniently(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"id": "r",\n "duration": 2.5}')
    (tmp_path / "bad.json").write_text('{"id": ')
    read = lambda strict: sorted(r["id"] for r in files.entities(spark, str(tmp_path), files.REFERENCE, strict).collect())
    assert read(False) == ["r"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read(True)


def test_renders_from_takes_to_delivery(spark, tmp_path):
    rows = [("r1", 0, 1, False, 0.5, "clipping", 2.0), ("r1", 0, 2, True, 0.9, "", 3.0), ("r1", 1, 1, True, 0.85, "", 1.0), ("r2", 0, 1, True, 0.95, "", 4.0), ("r2", 0, 2, True, 0.99, "", 4.0)]
    scored = spark.createDataFrame(rows, "render string, part int, take int, ok boolean, q double, reason string, duration double").withColumn("longest_pause", F.lit(0.2))
    requests = spark.createDataFrame([("r1", "a", "Ann", "e"), ("r2", "b", "Bo", "e")], "render string, voice string, speaker string, engine string")
    ledger = spark.createDataFrame([record("a", 1, "verified"), record("b", 1, "attested", "attested")], LEDGER)
    fine = lambda df: df.withColumns({"probability": F.lit(0.9), "payload": F.lit(True), "true_peak": F.lit(-2.0)})
    out = {r["render"]: r for r in flows.render(scored, requests, lambda: ledger, fine, f"{tmp_path}/out").collect()}
    assert out["r1"]["q"] == pytest.approx((0.9 * 3 + 0.85) / 4) and (out["r1"]["takes"], out["r1"]["duration"]) == (3, 4.0) and (out["r2"]["q"], out["r2"]["takes"]) == (0.95, 1)
    assert {r["tags"]["cadenza_consent"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"spoken", "attested"}
    with pytest.raises(takes.NeverPassed, match="part 0"):
        flows.render(scored.where("take = 1"), requests, lambda: ledger, fine, f"{tmp_path}/no")
    with pytest.raises(PermissionError, match="'b'"):
        flows.render(scored, requests, lambda: ledger.where("voice = 'a'"), fine, f"{tmp_path}/no")
    replaced = ledger.unionByName(spark.createDataFrame([record("a", 2, "verified", day=9)], LEDGER))
    calls = iter([ledger, replaced])
    with pytest.raises(PermissionError, match="consent changed"):
        flows.render(scored, requests, lambda: next(calls), fine, f"{tmp_path}/no")
    with pytest.raises(ValueError, match="watermark"):
        flows.render(scored, requests, lambda: ledger, lambda df: fine(df).withColumn("payload", F.lit(False)), f"{tmp_path}/no")
    with pytest.raises(KeyError):
        flows.chosen_parts(scored, "perfect")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert [r["seed"] for r in flows.seeds(7, spark.createDataFrame([(0,), (2,)], "part int"), 2).orderBy("part", "take").collect()] == [7, 8, 2007, 2008]
    words = consent.new_code(["reef", "owl"]).split()
    assert len(words) == 4 and set(words[:3]) <= {"reef", "owl"} and 10 <= int(words[3]) <= 99

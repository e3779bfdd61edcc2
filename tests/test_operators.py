from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.operators import consent, gates, ranking, segment, similar, takes
from cadenza.sources import delivery, files
from cadenza.streaming import ledger as streams


def test_clip_cutter_on_a_sentence_stream_and_an_unbroken_one():
    start, end, closes, at = [], [], [], 0.0
    for i in range(40):
        start.append(at)
        end.append(at + 0.35)
        closes.append(i % 8 == 7)
        at += 0.35 + (0.4 if i % 8 == 7 else 0.05)
    got = segment.cut_points(np.array(start), np.array(end), np.array(closes))
    assert got and all(4 <= end[j] - start[i] <= 14 and closes[j] for i, j in got)
    start = np.arange(100) * 0.31
    assert segment.cut_points(start, start + 0.3, np.zeros(100, bool))[1:] == [] and segment.cut_points(np.zeros(0), np.zeros(0), np.zeros(0, bool)) == []


def slow_cut(start, end, closes):
    n, out, i = len(start), [], 0
    while i < n:
        best = None
        if i == 0 or start[i] - end[i - 1] >= 0.12:
            ends, wide = [], []
            for j in range(i, n):
                d, gap = end[j] - start[i], start[j + 1] - end[j] if j + 1 < n else 1.0
                if d > 14:
                    break
                if d >= 4 and gap >= 0.12:
                    if closes[j] and d >= 7:
                        ends.append((j, d))
                    if gap >= 0.25:
                        wide.append(j)
            best = next((j for j, d in ends if d >= 10), ends[-1][0]) if ends else wide[0] if wide else None
        out += [] if best is None else [(i, best)]
        i = i + 1 if best is None else best + 1
    return out


def test_clip_cutter_against_a_plain_scan():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 80)
        start = np.cumsum(rng.choice([0.01, 0.13, 0.3], n) + 0.4)
        closes = rng.random(n) < 0.2
        assert segment.cut_points(start, start + 0.4, closes) == slow_cut(start, start + 0.4, closes)
        # lengths that meet the limits to the bit, and words that overlap
        start = np.cumsum(rng.choice([0.5, 0.75, 1.0], n))
        for end in (start + 0.25, start + rng.choice([0.25, 1.5], n)):
            assert segment.cut_points(start, end, closes) == slow_cut(start, end, closes)


def test_clips_of_rows_with_nulls_and_without_words(spark):
    words = [(f"w{i}" + "." * (i % 8 == 7), 0.4 * i + 0.4 * (i // 8), 0.4 * i + 0.4 * (i // 8) + 0.35, -0.5) for i in range(24)]
    rows = [("a", words), ("b", []), ("c", None), ("d", words), ("e", [(None, 0.0, 1.0, -1.0)])]
    df = spark.createDataFrame(rows, "key string, words array<struct<text:string,start:double,end:double,logprob:double>>").coalesce(1)
    got = segment.clips(df).orderBy("key", "clip").collect()
    assert {r["key"] for r in got} == {"a", "d"} and got[0]["text"].startswith("w0 w1") and got[0]["text"].endswith(".") and got[0]["confidence"] == pytest.approx(np.exp(-0.5)) and got[0]["n_words"] == len(got[0]["text"].split())
    laid = segment.timed(spark.createDataFrame([(1, ["x", "y", "z"], [0.2, 0.3, 0.1], [0.1, 0.0, 0.5], [-1.0, -2.0, -3.0]), (2, None, None, None, None), (3, ["q"], [1.0], [0.0], [0.0])], "key int, texts array<string>, long array<double>, gap array<double>, logprob array<double>").coalesce(1))
    got = {r["key"]: [(w["text"], w["start"], w["end"]) for w in r["words"]] for r in laid.collect()}
    assert got == {1: [("x", 0.0, 0.2), ("y", 0.3, 0.6), ("z", 0.6, 0.7)], 2: [], 3: [("q", 0.0, 1.0)]}


def test_tokens_to_words(spark):
    tokens = [(".", 0.0, 0.1, -1.0), (" hel", 0.5, 0.1, -0.2), ("lo", 0.6, 0.1, -0.4), ("!", 0.7, 0.1, -0.6), (" ", 0.8, 0.1, -9.0), (" world", 1.0, 0.2, -0.1)]
    df = spark.createDataFrame([(tokens,)], "t array<struct<token:string,start:double,duration:double,logprob:double>>")
    got = df.select(segment.grouped_tokens(F.col("t")).alias("w")).first()["w"]
    assert [(w["text"], w["start"]) for w in got] == [("hello!", 0.5), ("world", 1.0)] and got[0]["logprob"] == pytest.approx(-0.4)


def test_best_of_against_a_sequential_rule(spark):
    rng = random.Random(2)
    rows = [(p, k, rng.random() < 0.6, rng.choice([0.5, 0.7, 0.8, 0.85, 0.94])) for p in range(300) for k in range(1, rng.randint(2, 12))]
    for preset in takes.PRESETS:
        name, most, enough = preset
        want = {}
        for p in range(300):
            best, passed, used = None, 0, 0
            for _, k, ok, q in [r for r in rows if r[0] == p][: most + (1 if name == "fast" else 2)]:
                used, passed = k, passed + ok
                if best is None or (ok, q) > best[:2]:
                    best = (ok, q, k)
                if best[0] and (best[1] >= enough or passed >= most):
                    break
            want[p] = (best[2], best[0], best[1], used)
        got = takes.best_of(spark.createDataFrame(rows, "part long, take long, ok boolean, q double").repartition(5), preset).collect()
        assert {r["part"]: (r["take"], r["ok"], r["q"], r["consumed"]) for r in got} == want


def test_diverse_top_and_clusters(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=192)
    rows = [(i, "a.wav", 70.0 * i if i < 12 else 10.0, float(-i if i < 12 else 5), (base + 0.3 * rng.normal(size=192)).tolist(), 1) for i in range(13)]
    df = spark.createDataFrame(rows, "pos long, source string, start double, score double, emb array<double>, pool long")
    got = ranking.diverse_top(df, ["pool"], 5).collect()
    starts = sorted(r["start"] for r in got)
    assert len(got) == 5 and min(np.diff(starts)) >= 60
    a, b = rng.normal(size=192), rng.normal(size=192)
    rows = [(i, ((a if i < 14 else b) + 0.04 * rng.normal(size=192)).tolist(), 8.0) for i in range(19)]
    df = spark.createDataFrame(rows, "id long, v array<double>, duration double")
    pairs = ranking.similar_pairs(df, "id", "v", 0.5)
    assert pairs.count() == 14 * 13 // 2 + 5 * 4 // 2
    clusters = ranking.density_clusters(df, "v", 0.5)
    assert sorted(r["count"] for r in clusters.groupBy("cluster").count().collect()) == [5, 14]
    assert ranking.dominant(clusters, df).first()["dominant"]
    blocks = similar.Blocks.of(df, "id", "v", F.col("duration"))
    sums = {r["id"]: r["d"] for r in similar.densities(blocks, blocks, 0.5).collect()}
    assert sums == {i: 8.0 * (14 if i < 14 else 5) for i in range(19)}
    # fewer than three rows: one cluster if alike, else each its own
    of = lambda *ids: sorted((r["cluster"], r["id"]) for r in ranking.density_clusters(df.where(F.col("id").isin(*ids)), "v", 0.5).collect())
    assert of(3) == [(1, 3)] and of(2, 5) == [(1, 2), (1, 5)] and of(5, 16) == [(1, 5), (2, 16)] and of(99) == []
    one = df.where("id = 3")
    assert ranking.dominant(ranking.density_clusters(one, "v", 0.5), one).first()["dominant"]


def test_robust_scores_and_budget(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0), ("g", 100.0), ("h", 5.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["z_x"] for r in ranking.robust_z(df, ["k"], ["x"]).collect()}
    assert got["g", 100.0] == 3 and got["h", 5.0] == 0 and got["g", 2.0] == pytest.approx(-0.5 / 1.4826)
    rows = spark.createDataFrame([("a", i, 250.0) for i in range(6)], "k string, n long, d double")
    assert ranking.budget_prefix(rows, ["k"], [F.col("n")], "d", 600).count() == 3


def test_medians_of_large_groups_equal_those_of_small_ones(spark):
    rng = np.random.default_rng(7)
    rows = [("even", float(x), float(i % 3)) for i, x in enumerate(rng.normal(size=4000))] + [("odd", float(x), None) for x in rng.integers(0, 5, 1001)] + [("one", 2.0, 4.0), ("tie", 1.0, 1.0), ("tie", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    plain, large = ({r["k"]: (r["x"], r["y"]) for r in ranking.medians(df, ["k"], ["x", "y"], large).collect()} for large in (False, True))
    assert plain == large and plain["even"][0] == float(np.median([r[1] for r in rows if r[0] == "even"]))
    a, b = (sorted((r["k"], r["x"], r["z_x"]) for r in ranking.robust_z(df, ["k"], ["x"], large=large).collect()) for large in (False, True))
    assert a == b


def test_gates_and_consent(spark, tmp_path):
    x = spark.createDataFrame([({"Music": 0.3, "Radio": 0.1, "Echo": 0.5, "Speech": 0.9},)], "e map<string,double>")
    assert x.select(gates.contaminants(F.col("e"))).first()[0] == "contains Echo, Music"
    ledger = spark.createDataFrame([(1, 1, 1, "pending"), (1, 2, 5, "verified"), (2, 1, 1, "attested"), (2, 2, 9, "revoked"), (2, 3, 12, "attested")], "voice long, seq long, ts long, status string")
    assert {r["voice"]: r["usable"] for r in consent.current(ledger).collect()} == {1: True, 2: True}
    probes = spark.createDataFrame([(1, 1, 3), (2, 2, 9), (3, 3, 1)], "voice long, probe long, at long")
    assert {r["probe"]: r["in_force"] for r in consent.as_of(ledger, probes).collect()} == {1: "pending", 2: "revoked", 3: None}
    assert consent.revocations(ledger).where("voice = 2 AND seq = 3").first()["needs_override"]
    good = spark.createDataFrame([(1, 0.9, True, {"comment": delivery.DISCLOSURE, "description": delivery.DISCLOSURE}, -1.0)], "voice long, probability double, payload boolean, tags map<string,string>, true_peak double")
    delivery.deliver(good, lambda: ledger, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    revoked = ledger.unionByName(spark.createDataFrame([(1, 3, 20, "revoked")], ledger.schema))
    for frame, state, error in ((good, revoked, PermissionError), (good.withColumn("true_peak", F.lit(0.0)), ledger, ValueError), (good.withColumn("payload", F.lit(None).cast("boolean")), ledger, ValueError)):
        with pytest.raises(error):
            delivery.deliver(frame, lambda state=state: state, f"{tmp_path}/no")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_tags_and_sidecars(spark, tmp_path):
    banner = "Input #0, ogg\n  Metadata:\n    COMMENT         : first\n                    : second\n    title           : T\n  Duration: 00:01:02.50, start\n    Metadata:\n      title           : other\n      artist          : A\nOutput #0\n  Metadata:\n    album : no"
    x = spark.createDataFrame([(banner, "title=a\\=b\n;note\n[STREAM]\nTitle= again \nartist=C\\;D \\#\nno tag\n#x=1")], "b string, m string")
    r = x.select(files.banner_tags(F.col("b")).alias("b"), files.metadata_tags(F.col("m")).alias("m"), gates.probe(F.col("b")).alias("p")).first()
    assert r["b"] == {"comment": "first\nsecond", "title": "T", "artist": "A"}
    assert r["m"] == {"title": "again", "artist": "C;D \\#", "#x": "1"} and r["p"]["duration"] == 62.5
    (tmp_path / "a.WAV").write_bytes(b"x")
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "B.ogg").write_bytes(b"y")
    got = files.media_manifest(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["path"], r["sha256"], r["length"]) for r in got] == [("000-B.ogg", hashlib.sha256(b"y").hexdigest(), 1), ("001-a.WAV", hashlib.sha256(b"x").hexdigest(), 1)]


def test_stream_of_the_ledger_equals_the_table(spark, tmp_path):
    schema = "voice long, seq long, status string"
    rows = [(v, s, random.Random(v * 31 + s).choice(["pending", "verified", "revoked"])) for v in range(5) for s in range(1, 6)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = streams.states(stream).writeStream.format("memory").queryName("ledger_states").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    out = {}
    for r in spark.table("ledger_states").collect():
        out[r["voice"]] = max(out.get(r["voice"], (0, "")), (r["seq"], r["status"]))
    assert out == {v: (s, status) for v, s, status in rows if s == 5}
    lines = spark.createDataFrame([('{"id": 1, "method": "load", "params": "{}"}',), ("noise",), ("{bad",)], "value string")
    assert [r["error"] for r in streams.protocol(lines).collect()] == [None, None, "bad request"]


SAID = "The quick brown fox jumps over the lazy dog near the river bank"


def test_take_evaluation_gates_in_order(spark):
    words = [(i * 0.3, i * 0.3 + 0.25) for i in range(13)]
    late = [(a + (2.5 if i > 5 else 0), b + (2.5 if i > 5 else 0)) for i, (a, b) in enumerate(words)]
    fine, nan = [0.1] * 46, [0.1] * 45 + [float("nan")]
    cases = [  # take, samples (10 a second), transcript, words, similarity, reason
        (1, fine, SAID, words, 0.75, ""),
        (2, nan, SAID, words, 0.75, "empty or broken audio"),
        (3, [0.1] * 2, SAID, words, 0.75, "empty or broken audio"),
        (4, [1.0] + fine, "", words, 0.1, "clipping"),
        (5, [0.1] * 300, SAID, words, 0.75, "implausible length (30.0s for ~4.6s of text)"),
        (6, fine, SAID.removesuffix(" river bank"), words, 0.1, "ending cut off or garbled"),
        (7, fine, SAID + " near the river bank near the river bank", late, 0.75, "repeated phrase: 'near the river'"),
        (8, fine, SAID.replace("quick brown", "slow"), late, 0.75, "wording off (character error 16%)"),
        (9, fine, SAID, late, 0.2, "dead air (2.6s pause)"),
        (10, fine, SAID, words, 0.2, "does not sound like the speaker (similarity 0.20)"),
        (11, None, None, None, None, "empty or broken audio"),
    ]
    schema = "part int, take int, samples array<double>, sr int, script string, transcript string, words array<struct<start:double,end:double>>, similarity double, f0_median double, rate_wps double, self_similarity double, voice_f0 double, voice_rate double"
    df = spark.createDataFrame([(1, t, s, 10, SAID, h, w, c, 150.0, 2.8, 0.8, 150.0, 2.8) for t, s, h, w, c, _ in cases], schema)
    out = takes.evaluate(df)
    got = {r["take"]: r for r in out.collect()}
    assert {t: r["reason"] for t, r in got.items()} == {t: reason for t, *_, reason in cases}
    assert all(r["ok"] == (t == 1) for t, r in got.items())
    assert got[1]["q"] == pytest.approx(0.5 * (0.75 - 0.15) / 0.65 + 0.35 + 0.15) and got[10]["similarity"] == 0.2
    assert [got[5][c] for c in ("q", "cer", "wer", "similarity", "sim_norm", "longest_pause")] == [0, 1, 1, 0, 0, 0]
    assert takes.best_of(out, takes.PRESETS[0]).first()["take"] == 1


def test_target_by_anchor_pick_and_dominance(spark):
    rng = np.random.default_rng(1)
    centres = np.linalg.qr(rng.normal(size=(192, 2)))[0].T

    def pool(a, b):
        e = np.stack([centres[0]] * a + [centres[1]] * b) + 0.04 * rng.normal(size=(a + b, 192))
        e /= np.linalg.norm(e, axis=1)[:, None]
        return spark.createDataFrame([(i, "a.wav", 20.0 * i, 8.0, v.tolist()) for i, v in enumerate(e)], "id long, source string, start double, duration double, emb array<double>"), e

    centre = lambda e: e.mean(0) / np.linalg.norm(e.mean(0))
    clips, e = pool(9, 10)
    find = lambda *a, **k: ranking.find_target(*a, **k).first()
    assert find(clips, anchor=centres[0].tolist(), target=centres[1].tolist())["centroid"] == pytest.approx(centre(e[:9]))
    assert find(clips, target=centres[1].tolist())["centroid"] == pytest.approx(centre(e[9:]))
    assert find(clips, pick=2)["n"] == 9
    with pytest.raises(ValueError, match="out of range"):
        find(clips, pick=3)
    with pytest.raises(ranking.AmbiguousSpeaker, match=r"voice 1: 53% of the speech, e.g. a.wav at 3:00, a.wav at 3:20, a.wav at 3:40"):
        find(clips)
    # nothing alike: the nearest fifth
    far = rng.normal(size=192) / 192
    sims = e @ far
    assert find(clips, anchor=far.tolist())["centroid"] == pytest.approx(centre(e[sims >= np.quantile(sims, 0.8)]))
    clips, e = pool(14, 4)
    assert find(clips)["centroid"] == pytest.approx(centre(e[:14]))
    assert find(pool(1, 0)[0])["n"] == 1
    with pytest.raises(ranking.AmbiguousSpeaker):
        find(pool(1, 1)[0])


def test_the_best_references_are_found_without_sorting_all_of_them(spark):
    """Nulls, NaN and ties stand where a sort by (fits, score, reference) puts them, and the rows that a sort sees are few."""
    nan = float("nan")
    rows = [(k, k % 2, [4.0, 8.0, 30.0, None][k % 4], [float(k % 97), None, nan, 5.0][k % 7 % 4]) for k in range(4000)] + [(9000, 7, 8.0, 1.0), (9001, None, 8.0, 1.0)]
    refs = spark.createDataFrame(rows, "reference long, voice long, duration double, score double")
    dimension = takes.engines(spark)
    both = refs.crossJoin(dimension).withColumn("fits", F.col("duration").between(F.col("window_low") - 1.5, F.col("window_high") + 3.0))
    w = W.partitionBy("voice", "engine").orderBy(F.desc("fits"), F.desc("score"), "reference")
    show = lambda x: sorted((tuple(r) for r in x.select("voice", "engine", "reference", "place").collect()), key=str)
    assert show(takes.references_for(refs, dimension, 3)) == show(both.withColumn("place", F.row_number().over(w)).where("place <= 3"))
    score = F.col("score")
    near = takes._bounded(refs, ["voice"], [score.isNotNull(), F.isnan(score)], score, "reference", 2, True)
    first = lambda x: sorted((tuple(r) for r in x.withColumn("n", F.row_number().over(W.partitionBy("voice").orderBy("score", "reference"))).where("n <= 2").select("voice", "reference").collect()), key=str)
    assert first(near) == first(refs) and near.where("score IS NOT NULL").count() <= 2
    plain = refs.where("score IS NOT NULL AND NOT isnan(score)").withColumn("score", F.col("reference") * 1.0)
    assert takes._bounded(plain, ["voice"], [score.isNotNull(), F.isnan(score)], score, "reference", 3, True).count() < 40

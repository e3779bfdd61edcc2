from __future__ import annotations

import math

import numpy as np
import pytest

from cadenza.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=100):
    """rows: vec_id -> (label, whole vector)."""
    ids = sorted(rows)
    labels = {i: rows[i][0] for i in ids}
    x = np.array([rows[i][1] for i in ids], object if any(abs(c) > 2**20 for i in ids for c in rows[i][1]) else np.int64)
    out = set()
    for q in ids:
        if q % every:
            continue
        scores = dict(zip(ids, (x @ np.array(rows[q][1], x.dtype)).tolist()))
        positives = sorted((i for i in ids if i != q and labels[i] == labels[q]), key=lambda i: (-scores[i], i))[:5]
        for p in positives:
            fits = sorted((i for i in ids if labels[i] != labels[q] and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]), key=lambda i: (-scores[i], i))[:5]
            out |= {(q, p, k, i, scores[p], scores[i]) for k, i in enumerate(fits, 1)}
    return out


def of_table(rows):
    out = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        out[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in v])
    return out


def got(df):
    rows = df.collect()
    out = {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_on_its_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    want = brute(of_table(rows))
    assert want and got(negatives.op12_hard_negatives(spark, f"/root/testdata/{sf}")) == want


def test_special_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=6).round(1).tolist()) for i in range(400)]  # many equal scores
    rows += [(i, 1, [0.5] * 6) for i in range(400, 620)]  # copies
    rows += [(700, None, [1.0] * 6), (701, 1, None), (702, 1, [1.0, None] * 3), (800, 1, [math.nan] * 6), (801, 1, [math.inf] * 6), (None, 1, [1.0] * 6), (900, 2, [0.0] * 6), (1000, 99, [0.3] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.selectExpr("*", "1 AS score", "2 AS rank", "3 AS block", "4 AS d").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(of_table(rows))
    assert len(want) > 100 and got(negatives.op12_hard_negatives(spark, str(tmp_path))) == want
    other = spark.createDataFrame([*[r for r in rows if r[2] and len(r[2]) == 6][:30], (5000, 1, [1.0] * 5), (3, 2, [9.0] * 6)], SCHEMA)  # another length, a repeated id
    x = negatives.usable(other.selectExpr("vec_id", "label", "transform(embedding, c -> double(floor(256 * double(c)))) AS vector"))
    assert x.where("vec_id = 5000").count() == 0 and x.where("vec_id = 3").count() == 1 and x.count() == 30


def test_no_rows_no_anchors_one_label(spark, tmp_path):
    for k, rows in enumerate(([], [(1, 1, [1.0]), (2, 2, [1.0])], [(100, 1, [1.0]), (101, 1, [1.0])], [(100, 1, [])])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        assert negatives.op12_hard_negatives(spark, f"{tmp_path}/{k}").collect() == []


def test_clustered_vectors_scan_a_small_part(spark, monkeypatch):
    """Keys prune: block pairs scored in all rounds, against all there are; results stay exact."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16)) * 4
    at = rng.integers(0, 40, 12_000)
    x = np.floor(256 * (centre[at] + 0.1 * rng.normal(size=(12_000, 16)))).astype(int)
    rows = {i: (int(rng.integers(0, 2)), v) for i, v in enumerate(x.tolist())}
    monkeypatch.setattr(negatives, "ROWS", 128)
    seen = spark.sparkContext.accumulator(0)
    plain = negatives.scored

    def counted(a, ids, labels, vectors, k):
        seen.add(len(a["ids"]) * len(ids))
        return plain(a, ids, labels, vectors, k)

    monkeypatch.setattr(negatives, "scored", counted)
    monkeypatch.setattr(negatives, "SAMPLE_BYTES", 500 * 8 * 16)
    table = spark.createDataFrame([(i, label, v) for i, (label, v) in rows.items()], "vec_id long, label int, vector array<int>")
    usable = negatives.usable(table.selectExpr("vec_id", "label", "transform(vector, c -> double(c)) AS vector"))
    assert got(negatives.mine(usable, usable.where("vec_id % 100 = 0"))) == brute(rows)
    assert seen.value < 0.5 * 2 * 120 * 12_000, seen.value / (2 * 120 * 12_000)


def test_large_numbers_stay_exact():
    a = np.array([[2**29, 1, -(2**29)]], np.int64)
    assert negatives.products(a, a).tolist() == [[2**59 + 1]]

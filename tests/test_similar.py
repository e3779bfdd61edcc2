from __future__ import annotations

import numpy as np
import pytest

from cadenza.operators import ranking, similar


def clustered(n, groups, dim=16, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return x * rng.uniform(0.5, 2, (n, 1))


def frame(spark, x, duration=None):
    rows = [(i, float(duration[i]) if duration is not None else 1.0, v) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "id long, duration double, emb array<double>")


@pytest.mark.parametrize("rows", [64, 2048])
def test_pairs_equal_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(similar, "ROWS", rows)
    x = np.vstack([clustered(700, 12), np.repeat(clustered(1, 1, seed=3), 80, axis=0)])  # copies as well
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for threshold in (0.6, 0.9):
        i, j = np.nonzero(np.triu(s >= threshold, 1))
        got = {(r["a"], r["b"]) for r in similar.similar_pairs(frame(spark, x), "id", "emb", threshold).collect()}
        assert got == set(zip(i.tolist(), j.tolist()))
    with pytest.raises(ValueError):
        similar.similar_pairs(frame(spark, x), "id", "emb", 0.0)


def test_clustered_vectors_visit_under_half_of_the_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "ROWS", 64)
    blocks = similar.Blocks.of(frame(spark, clustered(4000, 30)), "id", "emb")
    n = blocks.blocks.count()
    visited = blocks.pairs(blocks, 0.85, False).count()
    assert n >= 60 and visited < 0.5 * n * (n + 1) / 2, (n, visited)


def test_special_rows_and_no_rows(spark):
    rows = [(1, 1.0, [1.0, 0.0]), (2, 1.0, [2.0, 0.0]), (3, 1.0, [0.0, 0.0]), (4, 1.0, None), (5, 1.0, [1.0, None]), (6, 1.0, [float("nan"), 1.0]), (None, 1.0, [1.0, 0.0]), (7, None, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, duration double, emb array<double>")
    assert sorted((r["a"], r["b"]) for r in similar.similar_pairs(df, "id", "emb", 0.9).collect()) == [(1, 2), (1, 7), (2, 7)]
    assert similar.similar_pairs(df.where("false"), "id", "emb", 0.9).collect() == []
    assert sorted(tuple(r)[:3] for r in ranking.density_clusters(df, "emb", 0.9).collect()) == [(1, 1, 1), (1, 1, 2), (1, 1, 7)]
    assert ranking.density_clusters(df.where("false"), "emb").collect() == []


@pytest.mark.parametrize("rows", [50, 2048])
def test_clusters_equal_a_loop_that_counts_anew(spark, monkeypatch, rows):
    monkeypatch.setattr(similar, "ROWS", rows)
    x = clustered(500, 6, spread=0.5)
    duration = np.round(np.random.default_rng(2).uniform(1, 9, len(x)), 2)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, left, want = u @ u.T >= 0.6, np.ones(len(x), bool), {}
    for k in range(1, 5):
        if left.sum() < 3:
            break
        d = np.round((near & left) @ (duration * left), 6)
        best = max(np.flatnonzero(left), key=lambda i: (d[i], -i))
        for i in np.flatnonzero(left & near[best]):
            want[int(i)] = (k, int(best))
        left &= ~near[best]
    got = {r["id"]: (r["cluster"], r["medoid"]) for r in ranking.density_clusters(frame(spark, x, duration), "emb", 0.6).collect()}
    assert len({c for c, _ in want.values()}) == 4 and got == want


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """However many pairs of blocks there are, none of them is sent through an exchange."""
    monkeypatch.setattr(similar, "ROWS", 64)
    x = np.random.default_rng(2).normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    blocks = similar.Blocks.of(df, "id", "emb")
    pairs = blocks.meet(blocks, 0.8, False, lambda same, ids, _, v, ids2, __, v2: {"n": [1]}, "n long")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and " Exchange " not in plan and blocks.blocks.count() >= 900 // 64
    got = {(r["a"], r["b"]) for r in similar.similar_pairs(df, "id", "emb", 0.8).collect()}
    c = similar.cosines(x, x)
    assert got == {(i, j) for i, j in zip(*np.nonzero(c >= 0.8)) if i < j} and got

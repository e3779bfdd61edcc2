from __future__ import annotations

import numpy as np
import pytest

from cadenza.llm import neighbours


def brute(rows, every, k):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for j, q in enumerate(ids):
        if q % every == 0:
            s = (x * x[j]).sum(axis=1) / (norm * norm[j])
            out[q] = sorted(((-s[i], ids[i]) for i in range(len(ids)) if i != j))[:k]
    return out


def test_recall_on_unstructured_vectors(spark):
    rng = np.random.default_rng(0)
    rows = {i: rng.normal(size=64).astype(np.float32).tolist() for i in range(6000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    v = neighbours.usable(df)
    got = neighbours.nearest(v, v.where("vec_id % 50 = 0"), leaf=100).collect()
    want = brute(rows, 50, 5)
    hit = sum((r["query_id"], r["vec_id"]) in {(q, i) for q, b in want.items() for _, i in b} for r in got)
    assert len(got) == 5 * len(want) and hit / len(got) >= 0.9
    for r in got:
        a, b = np.array(rows[r["query_id"]]), np.array(rows[r["vec_id"]])
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_a_sample_bounded_by_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_BYTES", 100 * 8 * 32)
    rng = np.random.default_rng(2)
    rows = {i: rng.normal(size=32).astype(np.float32).tolist() for i in range(1500)}
    v = neighbours.usable(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>"))
    assert found_share(neighbours.nearest(v, v.where("vec_id % 50 = 0")).collect(), rows) >= 0.9


def found_share(got, rows, every=50, k=5):
    want = {(q, i) for q, b in brute(rows, every, k).items() for _, i in b}
    assert len({(r["query_id"], r["rank"]) for r in got}) == len(got) == len(want)
    return sum((r["query_id"], r["vec_id"]) in want for r in got) / len(want)


def test_recall_of_the_registered_query_on_its_table(spark):
    """At every size as registered; the small tables have no more than a leaf or two a level."""
    for sf in ("sf0.01", "sf0.1"):
        rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
        assert found_share(neighbours.op2_neighbours(spark, f"/root/testdata/{sf}").collect(), rows) >= 0.9


def test_clustered_vectors_take_a_small_part_of_an_exact_scan(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(40, 64))[rng.integers(0, 40, 8000)] + 0.15 * rng.normal(size=(8000, 64))).astype(np.float32)
    rows = dict(enumerate(x.tolist()))
    v = neighbours.usable(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>"))
    assert found_share(neighbours.nearest(v, v.where("vec_id % 50 = 0")).collect(), rows) >= 0.97
    u = neighbours.unit(x.astype(np.float64))
    forest = neighbours.Forest.fit(u, len(u))
    at = forest.leaves(u)
    held = np.stack([np.bincount(at[:, t], minlength=2**forest.depth) for t in range(at.shape[1])])
    ids = np.arange(len(u))
    scored = []
    for i, near in zip(range(0, 8000, 50), neighbours.to_sample(u[::50], ids[::50], u, ids)):
        limit = neighbours.reach(near, 5)
        on, near = forest.search(u[i], held, neighbours.VISIT * len(u), limit), forest.within(u[i], limit)
        scored.append(np.mean(np.any([on[t, at[:, t]] for t in range(at.shape[1])], axis=0) & np.all([near[t, at[:, t]] for t in range(at.shape[1])], axis=0)))
    assert np.mean(scored) < 0.3, np.mean(scored)


def test_copies_ties_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTORS", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(400)}
    for i in range(100, 300):
        rows[i] = rows[7]  # a large group of copies
    bad = [(900, None), (950, [0.0] * 8), (1000, [float("nan")] + [1.0] * 7), (1050, [1.0] * 7), (1100, [float("inf")] * 8), (None, [1.0] * 8), (1150, [None] + [1.0] * 7)]
    df = spark.createDataFrame([*rows.items(), *bad, (5, rows[5])], "vec_id long, embedding array<float>").selectExpr("*", "1 AS leaf", "2 AS v")
    v = neighbours.usable(df)
    got = neighbours.nearest(v, v.where("vec_id % 50 = 0"), leaf=60, visit=4.1).collect()
    want = brute(rows, 50, 5)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, n + 1, i) for q, b in want.items() for n, (_, i) in enumerate(b)}


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [-1.0, 0.1])], "vec_id long, embedding array<double>")
    v = neighbours.usable(df)
    assert [r["vec_id"] for r in neighbours.nearest(v, v.where("vec_id % 50 = 0")).orderBy("rank").collect()] == [3, 4]
    none = neighbours.usable(df.where("false"))
    assert neighbours.nearest(none, none).collect() == []


def test_ties_of_many_different_vectors_go_to_the_smallest_ids(monkeypatch):
    rng = np.random.default_rng(2)
    n, k = 60, 5
    scaled = np.array([1.0, 2.0, 4.0]) @ np.eye(3) * 2.0 ** rng.permutation(n)[:, None]  # one direction, no two equal
    binary = (rng.random((200, 12)) < 0.5).astype(float)
    binary = np.unique(binary[binary.sum(axis=1) == 6], axis=0)  # few different cosines
    for pairs in (65_536, 7):
        monkeypatch.setattr(neighbours, "PAIRS", pairs)
        for v in (scaled, rng.permutation(binary)):
            ids = rng.permutation(len(v))
            got = list(zip(*neighbours.best(ids[:20], v[:20], ids, v, k)))
            norm = np.sqrt((v * v).sum(axis=1))
            want = []
            for i in range(20):
                s = (v * v[i]).sum(axis=1) / (norm * norm[i])
                want += [(ids[i], b, -a) for a, b in sorted((-s[j], ids[j]) for j in range(len(v)) if j != i)[:k]]
            assert [x[:2] for x in got] == [x[:2] for x in want]
            assert [x[2] for x in got] == pytest.approx([x[2] for x in want])

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from cadenza.llm import quality


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def sample(n, seed):
    rng = random.Random(seed)
    syllables = ["the", "ing", "an", "er", "on", "re", "sta", "é", "ou", "li"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        bad = i % 3 == 0
        if bad:
            words = [[w + rng.choice(["###", "%%%"]) for w in words], [w for w in words for _ in range(8)], [w.upper() + "!!" for w in words]][i // 3 % 3]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def plain_score(net, text):
    """The network as loops over positions."""
    raw = (text or "").encode()
    n = quality.blocks_of(len(raw)) * 64
    b = list(raw) + [0] * (n - len(raw) + 3)
    z = np.zeros((n, quality.FILTERS))
    for p in range(n):
        for j in range(4):
            z[p] += net.filters[j][b[p + j]]
        gram = b[p - 7 : p + 1] if p >= 7 else None
        if gram and any(gram) and any(p - lag >= 7 and b[p - lag - 7 : p - lag + 1] == gram for lag in range(2, 32)):
            z[p] += net.stutter
    blocks = z.reshape(-1, 64, quality.FILTERS).max(axis=1)
    top = np.array([np.maximum(x, y) for x, y in zip(blocks, blocks[1:])]) if len(blocks) > 1 else blocks
    h = np.maximum(top + net.bias, 0)
    return 1 / (1 + np.exp(-(h.mean(axis=0) @ net.mean + h.max(axis=0) @ net.peak + net.base)))


def test_held_out_accuracy_and_special_rows(spark, make_docs):
    rows = sample(600, 1)
    docs = [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "the ing"), (1002, "the ing an er " * 30_000), (5, "again the ing")]
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(6, 0, 0), (6, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = make_docs(docs)
    net = quality.learn(frame, labels)
    got = quality.scored(frame, net).collect()
    assert len(got) == len(docs)
    score = {r["doc_id"]: r["score"] for r in got if r["doc_id"] != 5}
    assert all(0 <= s <= 1 for s in score.values())
    test = [(score[i], q) for i, _, q in rows if held(i) and i in score]
    assert len(test) > 100 and sum((s >= 0.7) == bool(q) for s, q in test) / len(test) > 0.95
    assert score[1000] == score[1001]
    kept = {r["doc_id"] for r in quality.keep_good(frame, labels).collect()}
    assert kept - {5} == {d for d, s in score.items() if s >= 0.7} - {5}


def test_score_equals_plain_loops_across_segments(monkeypatch):
    rows = sample(90, 2)
    net = quality.train([(t, q) for _, t, q in rows])
    monkeypatch.setattr(quality, "SEGMENT", 256)
    tables = net.tables()
    for text in [t for _, t, _ in rows[:12]] + ["", None, "x", "é" * 32, "ab " * 400]:
        assert net.score(text, tables) == pytest.approx(plain_score(net, text), abs=1e-4)


def test_no_or_one_class_of_labels(spark, make_docs):
    docs = make_docs([(1, "a"), (3, "b")])
    schema = "doc_id long, quality int"
    assert quality.learn(docs, spark.createDataFrame([], schema)) == 0.5
    assert quality.learn(docs, spark.createDataFrame([(i, 1) for i in range(9)], schema)) == 1.0
    assert [r["score"] for r in quality.scored(docs, 0.5).collect()] == [0.5, 0.5]
    assert quality.scored(docs.where("false"), 0.5).collect() == []

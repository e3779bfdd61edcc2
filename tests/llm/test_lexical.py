from __future__ import annotations

import math
import random
import re

import pytest

from cadenza.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    held = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            s = 0
            for t in set(terms(text)):
                if tf := w.count(t):
                    m = 50 + (50 * len(w) * n_docs) // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "w" + str(int(rng.paretovariate(0.6)) % 400)
    text = lambda size: "".join(rng.choice([word(), word().upper(), "É" + word()]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(size))
    docs = [(i, text(rng.choice([1, 5, 20, 60, 300]))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(70)]  # copies: ties beyond the first fifty
    docs += [(7, "the w1"), (7, "the w1"), (None, "w1 w2 w3"), (n + 100, None), (n + 101, ""), (n + 102, "... !?"), (n + 103, "end" + " " + "of"), (n + 104, docs[4][1] * 300)]
    items = [(i, text(rng.choice([1, 3, 30]))) for i in range(25)]
    items += [(100, docs[3][1]), (101, None), (102, ""), (103, "nothingknown"), (104, "the THE the"), (5, "w1 w2"), (None, "w3 of")]
    return docs, items


@pytest.mark.parametrize("shard", [16, 2048])
def test_ranking_against_brute_force(spark, make_docs, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    docs, items = corpus(random.Random(1), 400)
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS rank", "3 AS score")
    got = lexical.rank(make_docs(docs), frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_items_in_blocks_and_small_chunks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 3000)
    monkeypatch.setattr(lexical, "CHUNK", 500)
    monkeypatch.setattr(lexical, "POSTINGS", 100)
    docs, items = corpus(random.Random(2), 60)
    got = lexical.rank(make_docs(docs), spark.createDataFrame(items[:14] + items[25:], "item_id long, text string"), 3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items[:14] + items[25:], 3)


def test_most_items_are_proven_above_the_last_tier(spark, make_docs, monkeypatch):
    """Rare terms decide: few postings are read for them, and the postings of frequent terms are left where they are."""
    rng = random.Random(4)
    docs = [(i, " ".join(["the"] * rng.randint(1, 9) + [f"c{rng.randrange(30)}" for _ in range(40)] + [f"r{rng.randrange(60)}"] * (i % 3 == 0))) for i in range(3000)]
    items = [(i, f"the c{i % 30} r{i}") for i in range(60)]
    plain = lexical.in_shard

    depths = spark.sparkContext.accumulator(0)

    def noted(row, all_items, asked, depth, *more):
        depths.add(len(asked) * (depth == len(lexical.TIERS)))
        return plain(row, all_items, asked, depth, *more)

    monkeypatch.setattr(lexical, "in_shard", noted)
    got = lexical.rank(make_docs(docs, extra=False), spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 5)
    shards = 3  # of make_docs' partitions
    assert depths.value < 0.5 * len(items) * shards, depths.value


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(make_docs([(1, "a")]), none).collect() == []
    assert lexical.rank(make_docs([(1, "a")]).where("false"), one).collect() == []

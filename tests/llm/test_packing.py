from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cadenza.llm import packing


def best_fit(histogram, size):
    from bisect import bisect_left, insort

    free, n = [], 0
    for length in sorted((x for x, k in histogram.items() for _ in range(k)), reverse=True):
        k = bisect_left(free, length)
        if k < len(free):
            room = free.pop(k)
        else:
            room, n = size, n + 1
        if room > length:
            insort(free, room - length)
    return n


def test_nnls_finds_a_known_solution():
    rng = np.random.default_rng(1)
    a = rng.random((30, 60))
    x = np.where(rng.random(60) < 0.2, rng.random(60), 0)
    got = packing.nnls(a, a @ x)
    assert got.min() >= 0 and np.abs(a @ got - a @ x).max() < 1e-6


def test_plan_covers_the_histogram_and_is_never_worse_than_best_fit():
    rng = random.Random(3)
    for size, kind in ((2048, "mixed"), (2048, "long"), (100, "any"), (2048, "few")):
        histogram = {}
        for _ in range(20_000 if kind != "few" else 7):
            n = min(size, max(1, int(rng.lognormvariate(6.3, 0.9)))) if kind != "long" else rng.randint(size // 3, size)
            histogram[n] = histogram.get(n, 0) + 1
        plan = packing.plan(histogram, size)
        used = {}
        for lengths, k in plan:
            assert sum(lengths) <= size and k > 0
            for n in lengths:
                used[n] = used.get(n, 0) + k
        assert used == histogram
        total = sum(k for _, k in plan)
        assert total <= best_fit(histogram, size), (kind, total, best_fit(histogram, size))


def test_pack_matches_the_tokenizer_and_leaves_no_gap(spark, make_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé,.'st ") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\x1cb \x1d c"), (103, "it's ÉCOLE éx <|endoftext|>done"), (104, "long word " * 4000), (5, "again"), (5, "again"), (None, "no id")]
    out = packing.pack(make_docs(rows)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    want = []
    for d, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:5] for r in out], key=key) == sorted(want, key=key)
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    histogram = {}
    for w in want:
        histogram[w[3]] = histogram.get(w[3], 0) + 1
    assert len(held) <= best_fit(histogram, 2048)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_patterns_pack_the_given_tables_as_tightly_as_best_fit(sf):
    import pyarrow.parquet as pq

    ids, histogram = packing.word_ids(packing.tokenizer_file()), {}
    for x in ids.many(t or "" for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist()):
        n = len(x) // 4 + 1
        for length in [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0):
            histogram[length] = histogram.get(length, 0) + 1
    plan = packing.plan(histogram)
    patterned = sum(k for p, k in plan if 2 <= len(p) <= packing.PARTS and sum(p) == 2048)
    whole = histogram.get(2048, 0)
    total = sum(k for _, k in plan)
    assert total == best_fit(histogram, 2048) and patterned > (0.25 if sf == "sf0.001" else 0.6) * (total - whole)


def test_patterns_do_the_packing_where_they_fit():
    histogram = {1024: 400, 700: 300, 1348: 300, 300: 100, 848: 200}
    plan = packing.plan(histogram)
    assert sum(k for _, k in plan) == 600 and sum(k for p, k in plan if sum(p) == 2048) == 500
    assert (64, 64) in [p for p, _ in packing.fit(histogram, 128, 16, 3)]


def test_another_tokenizer_encodes_whole_texts():
    name = lambda: packing.tokenizer_file("byte_bpe_50k.json")
    ids, tokenizer = packing.WordIds(name()), Tokenizer.from_file(name())
    for text in ("The Word, it's  HERE\n\nand 1984", "", "école ÉCOLE", "the the the"):
        assert ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_empty_table(make_docs):
    assert packing.pack(make_docs([(1, "x")]).where("false")).collect() == []


def test_remembered_words_give_the_ids_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    ids = packing.WordIds(packing.tokenizer_file())
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    rng = random.Random(11)
    bits = ["The", "the", "É", "école", "'s", "'", ".", ",", "***", "!!", "9", "42", "<|endoftext|>", "<|", "|>", "é", "İ", "Σ", "ß", "–", "日本", "́", "_", "-", "\xa0", " ", "n't", "½"]
    texts = ["", " \n", "\x85a\xa0b\x0bc"]
    texts += ["".join(rng.choice(bits) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    want = [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    for text, x in zip(texts, want):
        assert ids(text) == x, text
    for size in (1, 500, 1 << 22):  # one by one, some together, all together
        monkeypatch.setattr(packing, "CHARS", size)
        assert list(ids.many(texts)) == want
        plain = ["".join(c for c in t if ord(c) < 256 and c != "|") for t in texts]
        assert list(packing.WordIds(packing.tokenizer_file()).many(plain)) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in plain]

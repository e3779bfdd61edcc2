from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from cadenza.llm import common, simhash


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget):
    """doc id -> smallest doc id reachable."""
    ids = sorted(fps)
    out = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= budget and out[a] < out[b]:
                    out[b], changed = out[a], True
    return out


def brute_lanes(fps, budget, total=simhash.TOTAL):
    """key -> smallest key reachable; all rows against all, by every lane, and by the bits of all lanes together."""
    keys = sorted(fps)
    m = np.array([np.atleast_1d(fps[k]) for k in keys], dtype=np.uint64)
    label = np.arange(len(keys))
    bits = np.bitwise_count(m[:, None, :] ^ m[None, :, :]).astype(int)
    near = (bits <= budget).any(axis=2)
    if m.shape[1] > 1:
        near &= bits.sum(axis=2) <= total
    while True:
        new = np.array([label[near[i]].min() for i in range(len(keys))])
        if (new == label).all():
            return {k: keys[label[i]] for i, k in enumerate(keys)}
        label = new


def test_fingerprints_and_components(make_docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghEXÉ") for _ in range(rng.randint(1, 5)))
    rows = []
    for i in range(40):
        text = [word() for _ in range(rng.randint(1, 400))]
        for j in range(rng.randint(1, 3)):
            rows.append((len(rows), rng.choice([" ", "\n", "\x0b\t"]).join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, " x y z w\x85"), (906, "w " * 70_000), (906, "w " * 70_000), (None, "one")]
    got = simhash.classified(make_docs(rows)).collect()
    assert len(got) == len(rows)
    fps = {d: brute_fingerprint(t) for d, t in rows if d is not None}
    want = brute_components(fps, simhash.BUDGET)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fps"][0] & (1 << 64) - 1 == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    left = simhash.keep_one(make_docs(rows), 4, 4, 1).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted({d for d, _ in rows if d is not None and want[d] == d})  # of 906, which is there twice, one row


def test_trie_join_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    for budget, subtree in ((4, 20_000), (4, 8), (2, 3), (7, 50)):
        centres = rng.integers(0, 2**64, 30, dtype=np.uint64)
        flips = np.zeros(600, np.uint64)
        for _ in range(3):
            flips ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
        fp = np.unique(np.concatenate([centres[rng.integers(0, 30, 600)] ^ flips, centres, rng.integers(0, 2**64, 300, dtype=np.uint64)]))
        classes = spark.createDataFrame([(i, [int(x)]) for i, x in enumerate(fp.view(np.int64))], "id long, fps array<long>")
        found = {r["node"]: r["component"] for r in simhash.components(simhash.links(classes, budget, subtree=subtree)).collect()}
        want = brute_lanes(dict(enumerate(fp)), budget)
        assert [found.get(i, i) for i in range(len(fp))] == [want[i] for i in range(len(fp))]


def test_lanes_against_all_pairs_where_rows_share_a_fingerprint(spark):
    """Equal fingerprints of a lane stand for themselves: what one of them isn't near to, another may be."""
    rng = np.random.default_rng(8)
    for subtree in (20_000, 20):
        base = rng.integers(0, 2**64, (12, 3), dtype=np.uint64)
        fps = base[rng.integers(0, 12, 400)]
        for lane in range(3):
            for _ in range(6):
                on = rng.random(400) < 0.5
                fps[on, lane] ^= np.uint64(1) << rng.integers(0, 64, on.sum()).astype(np.uint64)
        fps[200:300, 0] = fps[200, 0]
        fps[300:360, 1:] = fps[300, 1:]
        fps = np.unique(fps, axis=0)
        classes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(fps.view(np.int64))], "id long, fps array<long>")
        found = {r["node"]: r["component"] for r in simhash.components(simhash.links(classes, 3, 10, subtree)).collect()}
        want = brute_lanes(dict(enumerate(fps)), 3, 10)
        assert [found.get(i, i) for i in range(len(fps))] == [want[i] for i in range(len(fps))] and 20 < len(set(want.values())) < 380


def test_an_unrelated_document_with_one_equal_fingerprint_costs_no_link(spark):
    one, rest = [7, 0, 0], [7, -1, -1]
    near = [7, -1, -2]
    classes = spark.createDataFrame([(1, one), (2, rest), (3, near)], "id long, fps array<long>")
    assert [tuple(r) for r in simhash.components(simhash.links(classes, 7, 60)).collect()] == [(3, 2)]


def test_lanes_link_what_any_of_them_links(make_docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(25):
        text = [word() for _ in range(120)]
        for _ in range(4):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    rows += [(500, rows[0][1]), (501, None), (502, "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.classified(make_docs(rows), 5, 6, 3, 30).collect()}
    want = brute_lanes({d: simhash.fingerprint(t, 5, 3) for d, t in rows}, 6, 30)
    assert got == want and len(set(want.values())) < 40


def test_keep_one_goes_by_rows(make_docs):
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200))
    a, b, c = text(), text(), text()
    rows = [(3, a), (5, a), (5, b), (8, b + " more"), (None, a), (9, c), (9, c), (9, c), (7, None), (11, "")]
    docs = make_docs(rows).selectExpr("*", "'y' AS __ROW", "'z' AS k")
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(3, a), (5, b), (None, a), (9, c), (7, None)], key=str)


def test_short_texts_of_two_shingles_are_not_linked_by_chance(make_docs):
    """Half-set bits would leave such fingerprints nearly empty, and thousands of them within the budget."""
    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(6))) for i in range(4000)]
    assert len({r["component_id"] for r in simhash.classified(make_docs(rows), simhash.KEEP_WORDS, simhash.KEEP_BUDGET, simhash.KEEP_LANES).collect()}) == 4000


def test_recall_and_precision_of_the_lanes_by_true_similarity():
    rng = random.Random(12)
    found = {k: [] for k in (0.0, 0.6, 0.7, 0.8, 0.85)}
    for _ in range(2500):
        a = [str(rng.randrange(5000)) for _ in range(rng.choice([60, 200, 500]))]
        b = list(a)
        for _ in range(rng.randint(1, max(2, len(a) // 18))):
            b[rng.randrange(len(b))] = str(rng.randrange(5000))
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        similarity = len(x & y) / len(x | y)
        fps = {i: simhash.fingerprint(" ".join(t), simhash.KEEP_WORDS, simhash.KEEP_LANES) for i, t in enumerate((a, b))}
        found[max(k for k in found if k <= similarity)].append(brute_lanes(fps, simhash.KEEP_BUDGET)[1] == 0)
    share = {k: float(np.mean(v)) for k, v in found.items()}
    assert min(map(len, found.values())) > 100 and share[0.85] > 0.98 and share[0.8] > 0.9 and share[0.6] < 0.15 and share[0.0] < 0.01, share


def test_a_large_group_of_equal_fingerprints_is_walked_in_bounded_memory():
    rng = np.random.default_rng(3)
    lanes = np.zeros((6000, 3), np.uint64)
    lanes[:, 1:] = np.uint64(1) << rng.integers(0, 64, (6000, 2)).astype(np.uint64)
    lanes[3000:, 1:] ^= np.uint64(0xFFFFFFFF00000000)
    first = simhash.walk(np.zeros(6000, int), lanes[:, 0].copy(), 4, lanes, 40)
    assert (first[:3000] == 0).all() and (first[3000:] == 3000).all()


def test_a_large_dense_subtree_stays_small_in_links():
    rng = np.random.default_rng(7)
    fp = np.unique(np.uint64(1 << 60) ^ (np.uint64(1) << rng.integers(0, 40, 5000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 5000).astype(np.uint64)))
    first = simhash.walk(np.zeros(len(fp), int), fp, 4)
    assert (first == 0).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 7 for i in range(200, 260))


def test_rounds_of_components_write_as_many_files_as_links_need(spark, monkeypatch):
    """Under 100 shuffle partitions that stay as they are, few links lie in as many files as there are cores."""
    files, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: files.append((out := cut(df)).rdd.getNumPartitions()) or out)
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 300)], "a long, b long"))
        got = {r["node"]: r["component"] for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 300)}
    assert len(files) > 8 and max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_empty_table(make_docs):
    assert simhash.classified(make_docs([(1, "x")]).where("false")).collect() == []


def test_a_subtree_that_fits_a_task_is_not_dealt_out_over_the_shuffle_again(spark, monkeypatch):
    """All agree on the first block, so that subtree holds all of them; each further level over the shuffle would copy them `budget` + 1 times."""
    rng = np.random.default_rng(13)
    fp = rng.integers(0, 2**51, 24_000, dtype=np.uint64)
    fp[:400] = fp[400:800] ^ (np.uint64(1) << rng.integers(0, 51, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 51, 400).astype(np.uint64))
    fp = np.unique(fp)
    dealt, cut = [], simhash.common.cut
    monkeypatch.setattr(simhash.common, "cut", lambda df: dealt.append(df.columns) or cut(df))
    classes = spark.createDataFrame([(i, [int(x)]) for i, x in enumerate(fp.view(np.int64))], "id long, fps array<long>")
    found = {(r["a"], r["b"]) for r in simhash.links(classes).collect()}
    assert not [c for c in dealt if "fps" in c]
    want = set()
    for a in range(0, len(fp), 500):
        i, j = np.nonzero(np.bitwise_count(fp[a : a + 500, None] ^ fp[None, :]) <= simhash.BUDGET)
        want |= {(max(x, y), min(x, y)) for x, y in zip((i + a).tolist(), j.tolist()) if x != y}
    parts = lambda edges: {frozenset(x) for x in _groups(edges)}
    assert len(want) >= 390 and parts(found) == parts(want)


def _groups(edges):
    label = {}
    root = lambda x: x if label.setdefault(x, x) == x else root(label[x])
    for a, b in edges:
        label[root(a)] = root(b)
    out = {}
    for x in list(label):
        out.setdefault(root(x), set()).add(x)
    return out.values()

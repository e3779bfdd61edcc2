"""URL rules, line dedup, sharding and decontamination against brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from cadenza.llm import common, decontaminate, line_dedup, shards, url_rules

low = lambda t: t.encode().lower().decode()


def brute_verdict(url):
    host, path = url_rules.split_url(url)
    fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "://", "x", "http://com", "http://COM/en/", "a://.com/en/x", "http://evil.org/x.com/en/", "http://Éxample.NET/de/8?x", "http://example.net#/de/", "http://a.example.com/en/7/" + "y" * 50_000, "http://notexample.com/en/7", "http://com/en/://org/es/"]
    for _ in range(500):
        host = ".".join(rng.choice(["www", "example", "blog", "É"]) for _ in range(rng.randint(0, 3))) + rng.choice([".com", ".net", ".org", "", "com"])
        urls.append(f"http://{host}{rng.choice(['/en/', '/de/8', '/de/', '/es/1', '/EN/', '/en/7', ''])}{rng.choice(['', '?q', '#f', 'z'])}")
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.com/en/1"), (0, "again")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS key")
    got = url_rules.apply_rules(df).collect()
    assert sorted([tuple(r)[1:] for r in got], key=str) == sorted([brute_verdict(u) for _, u in rows], key=str)
    assert {r["page_id"]: tuple(r)[1:] for r in got if r["page_id"]} == {i: brute_verdict(u) for i, u in rows if i}
    assert url_rules.apply_rules(df.where("false")).collect() == []


def test_globs_match_like_their_regular_expressions():
    rng = random.Random(2)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "é", "?", "*", "**", "/"]) for _ in range(rng.randint(1, 9))) for _ in range(30)]  # over 64 bits
        parts = {"**": ".*", "*": "[^/]*", "?": "."}
        patterns = [re.compile("".join(parts.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g)), re.S) for g in globs]
        texts = ["".join(rng.choice("abé/日") for _ in range(rng.randint(0, 14))) for _ in range(20)]
        got = url_rules.Automaton(globs).run(texts)
        assert got.tolist() == [[bool(p.fullmatch(t)) for p in patterns] for t in texts]


def test_line_dedup(spark, make_docs):
    rng = random.Random(3)
    lines = ["Short", " A line that is long enough ", "a LINE that is long enough\t", "Another line of some length é", "", "x" * 20, "y" * 19]
    rows = [(i, "\n".join(rng.choice(lines + [f"own line number {i} of this text"]) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, lines[1] + "\n" + "z\n" * 3000), (7, rows[7][1]), (None, lines[1])]
    key = lambda x: low(x.strip(" \t\n\x0b\f\r"))
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    want = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        gone = [d is not None and len(holders.get(key(x), ())) >= 3 and d != max(holders[key(x)]) for x in all_lines]
        want.append((d, len(all_lines), sum(gone), "\n".join(x for x, g in zip(all_lines, gone) if not g), gone))
    got = line_dedup.keep_bitmaps(make_docs(rows)).collect()
    unpacked = []
    for r in got:
        flags = [i % 2 == 1 for i, n in enumerate(r["keep_runs"]) for _ in range(n)]
        unpacked.append((r["doc_id"], r["n_lines"], r["n_dropped"], flags))
    assert sorted(map(str, unpacked)) == sorted(str((d, n, k, g)) for d, n, k, _, g in want)
    texts = line_dedup.deduplicate(make_docs(rows)).collect()
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in texts) == sorted(str((d, t)) for d, _, _, t, _ in want)
    assert "slice" in texts[0].asDict() and line_dedup.keep_bitmaps(make_docs(rows).where("false")).collect() == []


def test_shards(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, "t" * rng.randint(0, 50) + "é", rng.choice(["hot", "hot", "b", "c", None])) for i in range(997)] + [(5, "x", "b"), (5, "x", "b"), (None, None, "c")]
    got = shards.shard(make_docs(rows)).collect()
    sizes = [sum(r["shard"] == k for r in got) for k in range(40)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(str((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for d, t, _ in rows)
    for k in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    for source in ("hot", "b", "c", None):
        share = sum(s == source for *_, s in rows) / 40
        assert all(abs(sum(r["shard"] == k and r["source"] == source for r in got) - share) <= 2 for k in range(40))
    # ranks by the same hashes, worked out one row at a time
    chained = lambda *values: functools.reduce(lambda seed, v: seed if v is None else xxhash.xxh64_intdigest(v, seed), values, 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    eight = lambda v: None if v is None else v.to_bytes(8, "little", signed=True)
    seed = shards.SEED.to_bytes(4, "little")
    crc = lambda t: zlib.crc32((t or "").encode())
    line = []
    for source in {s for *_, s in rows}:
        mine = sorted((signed(chained(eight(d), eight(crc(t)), seed)), d is not None, d or 0, crc(t)) for d, t, s in rows if s == source)
        tie = signed(chained(None if source is None else source.encode(), seed))
        line += [((r + 0.5) / len(mine), tie, source is not None, source or "", d if there else None, c) for r, (_, there, d, c) in enumerate(mine)]
    line = [x[4:] for x in sorted(line, key=lambda x: x[:4])]
    assert [(r["doc_id"], r["text_crc32"]) for r in sorted(got, key=lambda r: r["position"])] == line
    assert [r["shard"] for r in sorted(got, key=lambda r: r["position"])] == [next(k for k in range(39, -1, -1) if k * len(rows) // 40 <= p) for p in range(len(rows))]
    again = shards.shard(make_docs(rows).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shards.shard(make_docs(rows).where("false")).collect() == [] and len(shards.shard(make_docs(rows[:3])).collect()) == 3


@pytest.mark.parametrize("limit, slots", [(64 << 20, 8), (100, 1 << 12), (100, 3)])
def test_decontamination(spark, make_docs, monkeypatch, limit, slots):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontaminate, "SLOTS", slots)
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "a", "b", "cats", "é9", "x1", "dogs", "and"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 12, 10, 9, 4, 14))] + [(6, "the of"), (7, None), (8, "..."), (9, ""), (10, "the OF!"), (None, "cats dogs cats")]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            text[3:3] = items[i % 6][1].upper().replace("É", "é").split()
        rows.append((i, rng.choice([" ", "-- ", "\n"]).join(text)))
    rows += [(70, None), (71, ""), (72, items[2][1] + " " + items[2][1]), (73, "the of " * 5000), (5, rows[5][1]), (None, items[0][1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if (own := windows.get(tuple(w[k : k + n]))) and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    ids |= {str(i) for i in own if i is not None}
        want.append((d, len(w), len(hit), sorted(ids), bool(hit)))
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window", "2 AS words")
    got = decontaminate.report(make_docs(rows), frame).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    kept = decontaminate.clean(make_docs(rows), frame).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(d) for d, *_, bad in want if not bad)
    none = decontaminate.report(make_docs(rows), frame.where("false")).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert decontaminate.report(make_docs(rows).where("false"), frame).collect() == []


def test_global_index_is_gapless_and_ordered(spark):
    df = spark.range(1000).selectExpr("id % 7 AS a", "id AS b").repartition(9)
    got = [(r["i"], r["a"], r["b"]) for r in common.globally_indexed(df, [df["a"], df["b"]], "i").collect()]
    assert [i for i, *_ in sorted(got)] == list(range(1000)) and [x[1:] for x in sorted(got)] == sorted(x[1:] for x in got)
    assert hashlib.sha256(b"").hexdigest()

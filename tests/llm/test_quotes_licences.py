from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from cadenza.llm import licences, quotes


def norm(t):
    return re.sub(r"\s+", " ", t.lower()).strip(" ")


def brute_threads(rows):
    own, parent = {}, {}
    split = lambda t: [(len(re.match(r"^(?:[ \t]*>)*", x).group().replace(" ", "").replace("\t", "")), re.sub(r"^(?:[ \t]*>)+", "", x)) for x in re.split("\r?\n", t)]
    runs = {}
    for c, n, _, t in rows:
        lines, out = split(t or ""), []
        for lv, x in lines:
            if out and out[-1][0] == lv:
                out[-1][1].append(x)
            else:
                out.append((lv, [x]))
        runs[c, n] = [(lv, norm(" ".join(x))) for lv, x in out]
        for body in [b for lv, b in runs[c, n] if lv == 0] + [norm(x) for lv, x in lines if lv == 0]:
            if body:
                own[c, body] = min(own.get((c, body), n), n)
    for (c, n), mine in runs.items():
        votes = {}
        for lv, body in mine:
            if lv and body and own.get((c, body), n) < n:
                o = own[c, body]
                votes[lv, o] = votes.get((lv, o), 0) + len(body)
        if votes:
            parent[c, n] = max((-lv, chars, o) for (lv, o), chars in votes.items())[2]
    return parent


def test_threads_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        texts = []
        for n in range(14):
            own = "\n".join(" ".join(rng.choice(["Yes", "no", "may be", "so", "What", "then"]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 3)))
            text = own
            if texts and rng.random() < 0.8:
                for _ in range(rng.randint(1, 3)):
                    quoted, deep = rng.choice(texts).split("\n"), rng.choice(["", "", "> "])
                    text = "\n".join(deep + rng.choice(["> ", ">", " > "]) + x for x in quoted) + "\n" + text
            texts.append(text)
            rows.append((c, n, "user", text))
    rows += [(50, 0, "user", None), (50, 1, "user", ""), (50, 2, "user", "> nobody said it\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS level", "2 AS hash", "3 AS position")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(df, by_line=False).collect()}
    parent = brute_threads(rows)
    assert len(parent) > 60 and len(got) == len(rows)
    for c in {c for c, *_ in rows}:
        order = []
        for _, n, _, text in [r for r in rows if r[0] == c]:
            root, depth = n, 0
            while (c, root) in parent:
                root, depth = parent[c, root], depth + 1
            r = got[c, n]
            assert (r["parent_turn"], r["root_turn"], r["depth"]) == (parent.get((c, n)), root, depth)
            lines = (text or "").split("\n")
            assert r["text"] == "\n".join(x for x in lines if not x.lstrip(" \t").startswith(">"))
            order.append((root, n))
        assert [got[c, n]["position"] for _, n in sorted(order)] == list(range(len(order)))


def test_null_keys_repeats_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "> a\nb"), (1, None, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, None, "> A \nfine")]
    got = quotes.conversations(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and [r["parent_turn"] for r in got if r["conv_id"] == 2 and r["turn"] == 1] == [0]
    assert quotes.conversations(spark.createDataFrame([], schema)).collect() == []


def brute_scan(files):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
    n = len(files)
    df = Counter(w for _, _, t in files for w in set(words(t or "")))
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1 if w in vocabulary else math.log(n + 1) + 1
    templates = {k: Counter(re.findall(r"[a-z0-9]+", v)) for k, v in licences.TEMPLATES.items()}
    vocabulary = {w for t in templates.values() for w in t}
    vector = lambda c: {w: k * idf(w) for w, k in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own, said = {}, {}
    for i, (d, path, text) in enumerate(files):
        parts = (text or "").split("\n")
        is_file = path is not None and re.match(r"(?i)^(licen[cs]e|copying)(\.\w+)?$", path.split("/")[-1])
        best = []
        for part in parts + ([f"{a} {b}" for a, b in zip(parts, parts[1:])] + [text or ""] if is_file else []):
            v = vector(Counter(words(part)))
            for name, t in templates.items():
                u = vector(t)
                s = round(sum(x * u.get(w, 0) for w, x in v.items()) / (size(v) * size(u)), 9) if v else 0
                if s >= licences.THRESHOLD:
                    best.append((-s, name))
        if best:
            own[i] = min(best)
            if is_file:
                folder = path.rsplit("/", 1)[0]
                said[folder] = min(said.get(folder, (9,)), (*min(best), path))
    out = []
    for i, (d, path, _) in enumerate(files):
        if i in own:
            out.append((d, path, own[i][1], own[i][1], None))
            continue
        folder, found = path.rsplit("/", 1)[0] if path and "/" in path else None, (None, None)
        while folder is not None:
            if folder in said:
                found = (said[folder][1], folder)
                break
            folder = folder.rsplit("/", 1)[0] if "/" in folder else None
        out.append((d, path, None, *found))
    return out


def test_scan_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "license", "under", "public", "free", "cats", "é", "of", "version", "3"])
    files = []
    for i in range(150):
        folder = rng.choice(["", "/a", "/a/b", "/a/b/c", "/d", "/d/e/f/g", "x"])
        text = "\n".join(" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.15:
            text += "\n" + rng.choice(list(licences.TEMPLATES.values())).upper() + rng.choice(["", ".", " and more words here", " cats"])
        files.append((i, f"{folder}/{rng.choice(['LICENSE', 'copying.txt', 'f.txt', 'g.md', 'h'])}", text))
    files += [(200, None, "Released under the MIT License."), (201, "lone.txt", "nothing"), (202, "/a/b/c/z", None), (203, "/a/y", ""), (203, "/a/y", "")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "1 AS word", "2 AS score", "3 AS dir")
    got = licences.scan(df).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted([(r["doc_id"], r["path"], r["own_licence"], r["licence"], r["from_dir"]) for r in got], key=key) == sorted(brute_scan(files), key=key)
    assert sum(r["own_licence"] is not None for r in got) > 10 and sum(r["from_dir"] is not None for r in got) > 10
    assert licences.scan(df.where("false")).collect() == []


def test_exact_notice_scores_one(spark):
    df = spark.createDataFrame([(1, "/x/f", "Text.\nReleased under the MIT License.")], "doc_id long, path string, text string")
    assert licences.scan(df).first()["own_score"] == pytest.approx(1)


@pytest.mark.parametrize("n", [2_000, 40_000])
def test_ordinary_words_weigh_by_their_own_rarity(spark, n):
    # the line keeps its score as the corpus grows in proportion
    line = "this code is released under the mit license"
    rest = spark.range(n).selectExpr("id AS doc_id", "concat('/a/f', id) AS path", "CASE WHEN id % 2 = 0 THEN 'this code is fine under the roof' ELSE 'the cats' END AS text").where("doc_id >= 4")
    held = spark.createDataFrame([(i, f"/b/f{i}", line) for i in range(4)], rest.schema)
    got = licences.own_licences(held.unionByName(rest).selectExpr("*", "doc_id AS __row")).where("doc_id < 4").collect()
    df = {w: n // 2 for w in ("this", "code", "is", "under")} | {"the": n} | {w: 4 for w in ("released", "mit", "license")}
    df |= {w: n // 2 + 2 for w in ("this", "code", "is", "under")}
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in df}
    template = licences.TEMPLATES["MIT"].split()
    score = math.sqrt(sum(idf[w] ** 2 for w in template)) / math.sqrt(sum(idf[w] ** 2 for w in line.split()))
    assert [(r["template"], r["score"]) for r in got] == [("MIT", pytest.approx(score))] * 4


def test_broken_titles_identifiers_and_altered_copies(spark):
    rng = random.Random(5)
    altered = licences.MIT_GRANT.split()
    for _ in range(6):
        altered[rng.randrange(len(altered))] = "otherwise"
    files = [
        (0, "/a/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy", "GPL-3.0"),
        (1, "/b/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
        (2, "/c/LICENSE.txt", "Apache License\nVersion 2.0, January 2004", "Apache-2.0"),
        (3, "/d/f.py", "# SPDX-License-Identifier: LGPL-2.1\nimport os", "LGPL-2.1"),
        (4, "/e/f.c", "// SPDX-License-Identifier: MIT", "MIT"),
        (5, "/f/LICENSE", "\n".join(" ".join(altered[i : i + 9]) for i in range(0, len(altered), 9)), "MIT"),
    ]
    rest = [(100 + i, f"/z/f{i}", "the cats is of a copy this and under to in by general version", None) for i in range(200)]
    got = {r["doc_id"]: r["own_licence"] for r in licences.scan(spark.createDataFrame([f[:3] for f in files + rest], "doc_id long, path string, text string")).collect()}
    assert got == {d: name for d, _, _, name in files + rest}


def test_partial_quotes_find_their_message(spark):
    mail = "Dear all,\nthe first point is money\nthe second point is time\nthe third point is rest\nBest, Ann"
    rows = [
        (1, 0, mail), (1, 1, "hello there\nsomething else"),
        (1, 2, "> the first point is money\n> the second point is time\nI agree"),  # greeting and signature trimmed
        (1, 3, "> Dear all,\n> the first point is money\nhow much?\n> the second point is time\n> the third point is rest\nnone"),  # interleaved
        (1, 4, "> hello there\n> nobody said this\n> something else\nwell"),  # a foreign line in between
        (1, 5, "> > the first point is money\n> > the second point is time\n> I agree\nme too"),  # the deeper level has more characters, but the shallower is what it answers
        (1, 6, "> nobody said this\n> nor this\nhm"), (1, 7, "> me too\n> hello there\n> something else\nok"),
        (2, 0, "> the first point is money\n> the second point is time\nanother conversation"), (2, 1, "> a later line\n> and one more\nno"), (2, 2, "a later line\nand one more\nand that"),
    ]
    messages = spark.createDataFrame([(c, n, "user", t) for c, n, t in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(messages).collect()}
    parents = {k: r["parent_turn"] for k, r in got.items()}
    assert parents == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 1, (1, 5): 2, (1, 6): None, (1, 7): 1, (2, 0): None, (2, 1): None, (2, 2): None}
    assert [t for (c, t), _ in sorted(got.items(), key=lambda x: x[1]["position"]) if c == 1] == [0, 2, 3, 5, 1, 4, 7, 6]


def test_the_query_links_the_replies_that_it_derives(spark, tmp_path):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["ann", "bob", "is", "it", "time", "money", "rest", "seven"]) + str(rng.randrange(99)) for _ in range(6))
    rows = [(c, t, "user", "\n".join(line() for _ in range(rng.randint(1, 4)))) for c in range(30) for t in range(8)]
    rows += [(3, 2, "user", rows[3 * 8 + 2][3]), (None, 1, "user", "x"), (40, None, "user", "y"), (41, 0, "user", None), (41, 1, "user", "after nothing")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS prev").write.parquet(f"{tmp_path}/conversations.parquet")
    got = quotes.op3_quotes(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    kind = lambda r: 0 if r["turn"] is None or r["conv_id"] is None or r["conv_id"] >= 40 or not r["turn"] else (r["conv_id"] + r["turn"]) % 4
    own = {(c, t): x for c, t, _, x in rows}
    for r in got:
        k = kind(r)
        previous = (own.get((r["conv_id"], (r["turn"] or 0) - 1)) or "").split("\n")
        assert r["text"] == (own[r["conv_id"], r["turn"]] or "")
        assert r["max_level"] == (0 if k == 0 or k == 2 and len(previous) < 2 else 2 if k == 3 and r["turn"] > 1 else 1)
        if r["max_level"]:
            assert r["parent_turn"] == r["turn"] - 1  # what it answers, never what that one has answered
        else:
            assert r["parent_turn"] is None


def test_standard_texts_and_near_relatives(spark):
    lines = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies": "MIT",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.": "ISC",
        "GNU Lesser General Public License, version 3": "LGPL-3.0", "GNU General Public License, version 2": "GPL-2.0", "GNU Affero General Public License, version 3": "AGPL-3.0",
        "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
    }
    rows = [(i, f"/d{i}/f", x) for i, x in enumerate(lines)] + [(100 + i, f"/z/f{i}", "the cats is of a copy this and under to in by") for i in range(200)]
    got = {r["doc_id"]: r["own_licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())
    assert all(got[100 + i] is None for i in range(200))

"""The pipeline against a brute-force version of each stage, on a few hundred documents."""

from __future__ import annotations

import random
import re
import zlib
from pathlib import Path

import numpy as np
from test_quality import plain_score
from test_simhash import brute_lanes
from tokenizers import Tokenizer

from cadenza.llm import common, packing, quality, simhash, stages


def corpus(seed=4):
    rng = random.Random(seed)
    syllables = ["the", "ing", "an", "er", "on", "re", "sta", "é", "ou", "li", "7", "qua"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(n))
    items = [" ".join(word() for _ in range(n)) for n in (30, 25, 12, 6)]
    rows, labels = [], []
    for i in range(240):
        text, bad = prose(rng.randint(3, 12)), i % 4 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split())
        elif i % 7 == 0:
            text += "\nThis very line is found in many documents.  "
        elif i % 11 == 0:
            text += "\n" + items[i // 11 % 4].encode().upper().decode()
        elif i % 13 == 0:
            text = rows[i - 13][1] if i % 2 else rows[i - 1][1] + " " + word()
        rows.append((i, text))
        labels.append((i, int(not bad)))
    return rows + [(300, None), (301, "")], labels, list(enumerate(items)) + [(9, None), (10, "")]


def ascii_lower(t):
    return t.encode().lower().decode()


def drop_lines(rows):
    found = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = ascii_lower(line.strip(" \t\n\x0b\f\r"))
            if len(key) >= 20:
                found.setdefault(key, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(found.get(k := ascii_lower(x.strip(" \t\n\x0b\f\r")), ())) >= 3 and d != max(found[k]))]
        out.append((d, t if len(kept) == len(lines) else "\n".join(kept)))
    return out


def keep_first(rows):
    label = brute_lanes({d: simhash.fingerprint(t, simhash.KEEP_WORDS, simhash.KEEP_LANES) for d, t in rows}, simhash.KEEP_BUDGET)
    return [(d, t) for d, t in rows if label[d] == d]


def clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = {tuple(w[i : i + 10]) for w in (words(t) for _, t in items) if w for i in range(max(1, len(w) - 9))}
    out = []
    for d, t in rows:
        w = words(t)
        if not any(tuple(w[i : i + n]) in windows for n in range(1, 11) for i in range(len(w) - n + 1)):
            out.append((d, t))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = quality.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [(d, t) for d, t in rows if plain_score(net, t) >= quality.THRESHOLD]
    assert 150 < len(want) < 200
    checks = [lambda x: x, drop_lines, keep_first, lambda x: clean(x, items)]
    for (name, stage), brute in zip(stages.STAGES, checks):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        before, want = want, brute(want)
        got = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in got if r["text"] is not None) == sorted(x for x in want if x[1] is not None), name
        assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
        assert name == "quality" or before != want
    packed = stages.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in want}
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == sorted((d, k // 2048, zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for d, x in ids.items() for k in range(0, len(x), 2048))
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    ran = stages.run(spark, str(tmp_path))
    left = {p.name for p in set(folder.iterdir()) - before}
    assert not any(n.startswith("pipeline-") for n in left) and len(left) < 8, left  # the last stage's cuts alone
    assert sorted(map(tuple, ran.drop("sequence_id", "offset").collect())) == sorted(map(tuple, spark.createDataFrame(packed).drop("sequence_id", "offset").collect()))

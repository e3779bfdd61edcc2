from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cadenza.llm import idcoder, idfiles, packing
from cadenza.sources import blobs


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000, 40_000, 200_000])
@pytest.mark.parametrize("kind", ["any", "few", "one", "text", "wide"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "any": rng.integers(0, 49408, n), "few": rng.integers(0, 3, n), "one": np.full(n, 49407), "wide": rng.integers(0, 200_000, n),
        "text": np.resize(rng.zipf(1.3, 997) % 49408, n) if n else np.zeros(0, int),
    }[kind].astype("<u4")
    vocabulary = 200_000 if kind == "wide" else 49408
    data = b"before" + idcoder.encode(ids, vocabulary) + b"after"
    got, end = idcoder.decode(memoryview(data), 6, vocabulary)
    assert (got == ids).all() and data[end:] == b"after"
    if n >= 200_000:  # what repeats takes next to nothing, what doesn't no more than its entropy and the cost of learning
        limit = {"any": 16.6, "few": 2.6, "one": 0.9, "text": 3.0, "wide": 18.8}[kind]
        assert 8 * len(data) / n < limit, 8 * len(data) / n


def test_carries_run_through_many_digits(monkeypatch):
    """Sure predictions, then a surprise, many times over: long runs of high digits."""
    rng = np.random.default_rng(1)
    ids = np.zeros(120_000, "<u4")
    ids[rng.integers(0, len(ids), 600)] = 49407
    assert (idcoder.decode(memoryview(idcoder.encode(ids, 49408)), 0, 49408)[0] == ids).all()


def test_every_altered_byte_is_found():
    maker = idfiles.FileMaker(100)
    rng = np.random.default_rng(2)
    want = [(None, 3), (4, 0), (4, 400), (9, 1)]
    want = [(d, rng.integers(0, 100, n).astype("<u4")) for d, n in want]
    for d, x in want:
        maker.add(d, x.tobytes())
    data = maker.close()
    assert [(d, x.tolist()) for d, x in idfiles.documents(data)] == [(d, x.tolist()) for d, x in want]
    for at in range(len(data)):
        if 8 <= at < 12:
            continue  # the vocabulary: another one gives other ids, whose checksum tells
        broken = bytearray(data)
        broken[at] ^= 0x10
        with pytest.raises((idcoder.Damaged, zlib.error, ValueError)):
            list(idfiles.documents(bytes(broken)))
    for cut in (0, 5, len(data) // 2, len(data) - 1):
        with pytest.raises(idcoder.Damaged):
            list(idfiles.documents(data[:cut]))


def test_files_of_documents_against_the_tokenizer(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(idcoder, "BLOCK", 1 << 22)
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), " ".join("".join(rng.choice("abcdeé,.'st") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 200)))) for _ in range(150)]
    rows += [(7, None), (7, ""), (8, "long word " * 30_000), (9, "twice"), (9, "twice"), (9, "other"), (None, "no id"), (-5, "below"), (2**62, "far")]
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    idfiles.write_ids(make_docs(rows), f"{tmp_path}/ids")
    got = sorted(idfiles.read_ids(spark, f"{tmp_path}/ids", ids=True).collect(), key=lambda r: r["start"])
    at, order = 0, [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    for r in got:
        ids = list(r["ids"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    want = sorted((d is not None, d or 0, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in got) == want
    with pytest.raises(Exception, match="FileExists"):
        idfiles.write_ids(make_docs(rows[:2]), f"{tmp_path}/ids")


def test_files_and_blocks_of_any_size(spark, make_docs, tmp_path, monkeypatch):
    """Documents over many blocks, and many files of a task."""
    rng = random.Random(1)
    maker_files = []
    monkeypatch.setattr(idcoder, "BLOCK", 50)
    lengths = [0, 1, 49, 50, 51, 500, 3] * 3
    docs = [(k, np.array([rng.randrange(49408) for _ in range(n)], "<u4")) for k, n in enumerate(lengths)]
    for k in range(0, len(docs), 5):
        maker = idfiles.FileMaker(49408)
        for d, x in docs[k : k + 5]:
            maker.add(d, x.tobytes())
        maker_files.append((f"part-{k:03d}.ids", maker.close()))
    files = spark.createDataFrame(maker_files, "name string, content binary").repartition(3)
    blobs.write_files(files, files["name"], files["content"], f"{tmp_path}/many")
    got = sorted(idfiles.read_ids(spark, f"{tmp_path}/many").collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_tokens"], r["start"]) for r in got] == [(k, n, sum(lengths[:k])) for k, n in enumerate(lengths)]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(x.tobytes()) for _, x in docs]


def test_registered_query_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in idfiles.op13_id_files(spark, sf).collect()}
    tokenizer, at = Tokenizer.from_file(packing.tokenizer_file()), 0
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(rows)
    for d, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_table(spark, make_docs, tmp_path):
    idfiles.write_ids(make_docs([(1, "x")]).where("false"), f"{tmp_path}/none")
    assert idfiles.read_ids(spark, f"{tmp_path}/none").collect() == []

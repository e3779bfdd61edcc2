"""Ranked lexical search over a tiered index.

The index is dealt out by documents: a shard holds up to `SHARD` of them.  A posting's impact is the most that it adds to a score; each shard
keeps the postings of the queries' terms by tier, high impacts first, as columns of one table, so that a round reads the tiers it needs, and
beside them the terms of each document.  For each term and tier, the largest impact that lies below is known.

A round adds up the impacts of the tiers read so far.  The sum of what an item's terms may add below bounds every document not met
yet, and with its own sum every other one.  Where that bound is under the k-th best exact score found so far, the documents
met whose bound reaches it are scored exactly out of their terms, and the item is proven.  Items that lack this proof fall
through to the next tier, with the exact scores of their best documents so far as a better k-th score.  Below the last tier nothing is left.

Weights, lengths and scores are whole numbers and cover all documents; queries come in blocks of bounded size.

Results in special cases
------------------------
* null or empty text: a document or item without terms, which is in no result and has none;
* null doc_id: a document like others, after them in ties; repeated doc_ids: a document for each row;
* null or repeated item_id: each row of the items is an item of its own;
* ties: ascending doc_id; fewer than k documents above score 0: all of them; empty tables: empty result;
* very long texts: read whole; further columns, however named, are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.files import filesystem
from . import common

BEST = 50
#: Documents and postings of a shard at most, shares of all postings in the tiers but the last, bytes of the items of a block, bytes read together.
SHARD, POSTINGS, TIERS, ITEM_BYTES, CHUNK = 2048, 1 << 20, (0.15, 0.35), 8 << 20, 1 << 22
#: A shard's documents per item that are scored exactly to raise the k-th best score.
PROBE = 8
_TERM = np.ones(256, bool)
_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_TERM[0x41:0x5B] = True
_LOWER = bytes(range(256)).lower()
_BINS = 512


def terms_of(data: bytes, offsets: np.ndarray) -> tuple[pa.DictionaryArray | None, np.ndarray]:
    """The terms of some UTF-8 texts in a row, dictionary-encoded, and where each text's begin and the last one's end."""
    data = data[offsets[0] : offsets[-1]].translate(_LOWER)
    offsets = offsets - offsets[0]
    b = np.frombuffer(data, np.uint8)
    solid = _TERM[b]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]  # a term ends with its text
    begins[first] = solid[first]
    begins = np.flatnonzero(begins)
    if not len(begins):
        return None, np.zeros(len(offsets), np.int64)
    lengths = np.add.reduceat(solid, begins, dtype=np.int32)
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(b[solid])]).dictionary_encode()
    return words, np.searchsorted(begins, offsets)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Stretches of a column of texts of about `CHUNK` bytes: first, end, their bytes, and their offsets."""
    column = column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = min(len(column), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right"))))
        at = offsets[lo : hi + 1]
        yield lo, hi, (data[int(at[0]) : int(at[-1])].to_pybytes() if data is not None else b""), at - at[0]
        lo = hi


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """A row per document: doc_id, n (its terms), terms and tfs (of those of the vocabulary, a broadcast of term -> number), as bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = vocabulary.value
        for batch in batches:
            for lo, hi, data, offsets in _texts(batch.column(1)):
                words, at = terms_of(data, offsets)
                n = np.diff(at)
                terms, tfs = [b""] * (hi - lo), [b""] * (hi - lo)
                if words is not None and known:
                    of_word = np.array([known.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
                    each = of_word[words.indices.to_numpy()]
                    doc = np.repeat(np.arange(hi - lo), n)
                    keys, tf = np.unique((doc * len(known) + each)[each >= 0], return_counts=True)
                    term, cuts = (keys % len(known)).astype(np.uint32), np.searchsorted(keys, np.arange(hi - lo + 1) * len(known)).tolist()
                    tf = tf.astype(np.uint32)
                    terms, tfs = ([x[a:z].tobytes() for a, z in zip(cuts, cuts[1:])] for x in (term, tf))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, terms binary, tfs binary")


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and where each row's begin."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.append(0, np.cumsum([len(x) for x in raw], dtype=np.int64)) // np.dtype(kind).itemsize


@dataclass
class Weights:
    """What the corpus says: documents with terms, all their terms, the weight of each term, and the least impact of each tier but the last."""

    n_docs: int
    n_terms: int
    weight: np.ndarray
    least: np.ndarray = None

    def shares(self, n: np.ndarray, tf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What a term's weight is multiplied by, for each posting; `at`: where each document's postings begin."""
        m = 50 + (50 * n * self.n_docs) // max(1, self.n_terms)
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(at)))


def weights(rows: DataFrame, size: int) -> Weights:
    """rows: as `counted` makes them; size: of the vocabulary.  A number for each term comes to the driver."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in batches:
            held += np.bincount(_joined(b.column(0), "<u4")[0], minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "df"])

    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n, df = total["n"], np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    out = Weights(n, total["terms"], np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_BINS, np.int64)
        for b in batches:
            (tf, at), term = _joined(b.column(2), "<u4"), _joined(b.column(1), "<u4")[0]
            held += np.bincount(_bin(out.weight[term] * out.shares(b.column(0).to_numpy(), tf, at)), minlength=_BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BINS)), pa.array(held)], names=["bin", "n"])

    held = np.zeros(_BINS, np.int64)
    for r in rows.select("n", "terms", "tfs").mapInArrow(impacts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        held[r["bin"]] = r["n"]
    above = np.cumsum(held[::-1])[::-1] / max(1, held.sum())  # share of the postings in a bin or a higher one
    shares = np.cumsum(TIERS)
    out.least = np.array([int(np.flatnonzero(above >= s).max(initial=0)) for s in shares])
    return out


def _bin(impact: np.ndarray) -> np.ndarray:
    """Sixteen bins for each doubling."""
    return np.minimum(_BINS - 1, (16 * np.log2(impact.astype(float) + 1)).astype(np.int64))


def build(rows: DataFrame, w, size: int, path: str) -> np.ndarray:
    """Writes the shards below `path`; returns tier x term: the largest impact of the tier."""
    tiers = len(TIERS) + 1

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Weights = w.value
        part, number, held, n_docs, n_postings = TaskContext.get().partitionId(), 0, [], 0, 0

        def made() -> pa.RecordBatch:
            nonlocal number, held, n_docs, n_postings
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n_docs, n_postings = [], 0, 0
            number += 1
            (tf, at), term = _joined(b.column(3), "<u4"), _joined(b.column(2), "<u4")[0]
            share = known.shares(b.column(1).to_numpy(), tf, at)
            impact = known.weight[term] * share
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            tier = tiers - 1 - (_bin(impact)[:, None] >= known.least).sum(axis=1)
            out = {"shard": (part << 32) | number, "doc_ids": b.column(0).fill_null(0).to_numpy().tobytes(), "known": b.column(0).is_valid().to_numpy(zero_copy_only=False).tobytes(), "at": at.astype("<u4").tobytes(), "terms": term.tobytes(), "shares": share.astype("<u4").tobytes()}
            tops = []
            for t in range(tiers):
                mine = np.flatnonzero(tier == t)
                mine = mine[np.argsort(term[mine], kind="stable")]
                named, first = np.unique(term[mine], return_index=True)
                top = np.maximum.reduceat(impact[mine], first) if len(mine) else np.zeros(0, np.int64)
                tops.append((named, top))
                out |= {f"named{t}": named.astype("<u4").tobytes(), f"first{t}": np.append(first, len(mine)).astype("<u4").tobytes(), f"docs{t}": doc[mine].astype("<u2").tobytes(), f"shares{t}": share[mine].astype("<u4").tobytes(), f"tops{t}": top.astype("<i8").tobytes()}
            return pa.RecordBatch.from_pylist([out], schema=kept)

        for b in batches:
            lengths = np.array([len(x) // 4 for x in b.column(2).to_pylist()])
            lo = 0
            while lo < len(lengths):
                more = np.cumsum(lengths[lo:])
                hi = lo + min(SHARD - n_docs, max(1 if not n_docs else 0, int(np.searchsorted(more, POSTINGS - n_postings, "right"))))
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                    n_docs, n_postings, lo = n_docs + hi - lo, n_postings + int(lengths[lo:hi].sum()), hi
                if n_docs >= SHARD or lo < len(lengths):
                    yield made()
        if held:
            yield made()

    each = ", ".join(f"named{t} binary, first{t} binary, docs{t} binary, shares{t} binary, tops{t} binary" for t in range(tiers))
    schema = f"shard long, doc_ids binary, known binary, at binary, terms binary, shares binary, {each}"
    kept = pa.schema([pa.field(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in schema.split(", ")])
    rows.mapInArrow(shards, schema).write.parquet(path)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((tiers, size), np.int64)
        for b in batches:
            for t in range(tiers):
                np.maximum.at(top[t], _joined(b.column(2 * t), "<u4")[0], _joined(b.column(2 * t + 1), "<i8")[0])
        t, term = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(term), pa.array(top[t, term])], names=["tier", "term", "top"])

    top = np.zeros((tiers, size), np.int64)
    columns = [c for t in range(tiers) for c in (f"named{t}", f"tops{t}")]
    for r in rows.sparkSession.read.parquet(path).select(columns).mapInArrow(highest, "tier long, term long, top long").groupBy("tier", "term").agg(F.max("top").alias("top")).collect():
        top[r["tier"], r["term"]] = r["top"]
    return top


def below(top: np.ndarray) -> np.ndarray:
    """tier x term: the most that a posting of a lower tier can add."""
    out = np.zeros_like(top)
    for t in range(len(top) - 2, -1, -1):
        out[t] = np.maximum(out[t + 1], top[t + 1])
    return out


def _gathered(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The places of all stretches [first, last), one after the other."""
    size = last - first
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def in_shard(row: dict, items: list[np.ndarray], asked: list[int], depth: int, weight: np.ndarray, rest: dict[int, int], least: dict[int, int], k: int) -> Iterator[tuple[int, int, int]]:
    """item, place in the shard, exact score: with proof (`rest` under `least`) all that may be among the first k, else the best few so far."""
    ids, known = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], bool)
    at, terms, shares = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("at", "terms", "shares"))
    tiers = [tuple(np.frombuffer(row[f"{c}{t}"], kind) for c, kind in (("named", "<u4"), ("first", "<u4"), ("docs", "<u2"), ("shares", "<u4"))) for t in range(depth + 1)]
    mask = np.zeros(len(weight), np.int64)
    for i in asked:
        mine = items[i]
        score = np.zeros(len(ids))
        for named, first, docs, share in tiers:
            place = np.searchsorted(named, mine)
            there = place < len(named)
            there[there] &= named[place[there]] == mine[there]
            lo, hi = first[place[there]].astype(np.int64), first[place[there] + 1].astype(np.int64)
            p = _gathered(lo, hi)
            # whole numbers under 2^53 are exact in floating point
            score += np.bincount(docs[p], share[p] * np.repeat(weight[mine[there]], hi - lo).astype(float), len(ids))
        score = score.astype(np.int64)
        proven = rest[i] < least[i]
        met = np.flatnonzero((score > 0) & (score + rest[i] >= least[i])) if proven else np.flatnonzero(score > 0)
        if not proven and len(met) > PROBE:
            met = met[np.argpartition(-score[met], PROBE - 1)[:PROBE]]
        if not len(met):
            continue
        exact = score[met]
        if rest[i]:
            mask[mine] = weight[mine]
            p = _gathered(at[met], at[met + 1])
            owner = np.repeat(np.arange(len(met)), at[met + 1] - at[met])
            exact = np.bincount(owner, (mask[terms[p]] * shares[p]).astype(float), len(met)).astype(np.int64)
            mask[mine] = 0
        order = np.lexsort((ids[met], ~known[met], -exact))[:k]
        for j in order[exact[order] >= max(1, least[i] if proven else 1)]:
            yield i, int(met[j]), int(exact[j])


def rank_block(docs: DataFrame, block: list[tuple[int, bytes]], k: int) -> DataFrame:
    """item (its number), rank, doc_id, score, for items (number, UTF-8 text) of bounded size."""
    spark = docs.sparkSession
    words, at = terms_of(b"".join(t for _, t in block), np.append(0, np.cumsum([len(t) for _, t in block], dtype=np.int64)))
    names = words.dictionary.to_pylist() if words is not None else []
    indices = words.indices.to_numpy() if words is not None else np.zeros(0, np.int64)
    items = [np.unique(indices[a:z]).astype(np.int64) for a, z in zip(at, at[1:])]
    rows = common.cut(counted(docs, spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})))
    found_w = weights(rows, len(names))
    w = spark.sparkContext.broadcast(found_w)
    path = f"{common.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    fs, place = filesystem(spark, path)
    try:
        rest_of = below(build(rows, w, len(names), path))
        shared = spark.sparkContext.broadcast(items)
        index = spark.read.parquet(path)
        pending, least, found = [i for i, x in enumerate(items) if len(x)], {i: 0 for i in range(len(items))}, None
        for depth in range(len(TIERS) + 1):
            if not pending:
                break
            rest = {i: int(rest_of[depth][items[i]].sum()) for i in pending}
            least = {i: max(1, least[i]) for i in pending}
            asked = spark.sparkContext.broadcast((pending, rest, least))

            def search(batches: Iterator[pa.RecordBatch], depth=depth, asked=asked) -> Iterator[pa.RecordBatch]:
                mine, rest, least = asked.value
                for b in batches:
                    columns = {name: b.column(name) for name in b.schema.names}
                    for r in range(b.num_rows):
                        row = {name: x[r].as_py() for name, x in columns.items()}
                        ids, known = np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["known"], bool).tolist()
                        got = list(in_shard(row, shared.value, mine, depth, w.value.weight, rest, least, k))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([g[0] for g in got], pa.int32()), pa.array([row["shard"]] * len(got), pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([ids[g[1]] if known[g[1]] else None for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                            names=["item", "shard", "place", "doc_id", "score"],
                        )

            columns = ["shard", "doc_ids", "known", "at", "terms", "shares", *(f"{c}{t}" for t in range(depth + 1) for c in ("named", "first", "docs", "shares"))]
            new = index.select(columns).mapInArrow(search, "item int, shard long, place int, doc_id long, score long")
            # what two rounds have found is the same
            every = new if found is None else new.unionByName(found).dropDuplicates(["item", "shard", "place"])
            best = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "shard", "place")
            found = common.cut(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
            proven = {i for i in pending if rest[i] < least[i]}
            pending = [i for i in pending if i not in proven]
            for r in found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k).collect():
                least[r["item"]] = max(least.get(r["item"], 0), r["s"])
        if found is None:
            return spark.createDataFrame([], "item long, rank int, doc_id long, score long")
        numbers = F.broadcast(spark.createDataFrame([(i, n) for i, (n, _) in enumerate(block)], "item int, number long"))
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "shard", "place")))
        return ranked.join(numbers, "item").select(F.col("number").alias("item"), "rank", "doc_id", "score")
    finally:
        fs.delete(place(path), True)


def rank(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of each item (item_id, text) with a score above 0."""
    numbered = common.cut(items.select("item_id", "text").withColumn("__item", F.monotonically_increasing_id()))
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks, out = -(-size // ITEM_BYTES), None
    for b in range(max(1, blocks)):
        mine = numbered.where(F.pmod(F.xxhash64("__item"), F.lit(max(1, blocks))) == b).select("__item", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        got = rank_block(docs, [(r["__item"], bytes(r["text"])) for r in mine.collect()], k)
        out = got if out is None else out.unionByName(got)
    return out.join(numbered.select("__item", "item_id"), F.col("item") == F.col("__item")).select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _terms_sql() -> str:
    return rf"regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS own, doc_id, {_terms_sql()} AS w FROM documents WHERE text IS NOT NULL
), i AS (SELECT row_number() OVER () AS item, item_id, {_terms_sql()} AS w FROM benchmark WHERE text IS NOT NULL
), q AS MATERIALIZED (SELECT DISTINCT item, item_id, unnest(w) AS term FROM i
), c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), tf AS MATERIALIZED (SELECT own, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT own, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY own, doc_id, term
), df AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term
), s AS (SELECT item, item_id, own, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY item, item_id, own, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, own)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

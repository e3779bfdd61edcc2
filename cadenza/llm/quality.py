"""Text quality by a byte-level convolutional network, written in numpy.

Learned filters of four bytes slide over every byte of a text; one more input tells where the last eight bytes have stood
shortly before, so that stuttering shows.  Filter responses are max-pooled over overlapping chunks that cover the whole
document; the chunks' activations are averaged and max-pooled over the document, and a logistic unit makes one
probability of both.  After training, filters are folded into tables of byte pairs: two look-ups a byte.

Training takes labelled rows in the order of a hash of doc_id, `SAMPLE` of them and `SAMPLE_BYTES` bytes of whole texts at most,
whatever the length of each (a single text over the budget is left out, as it would be all of it); that bound is all
the driver ever holds.  Scoring covers all rows and all bytes.

Results in special cases
------------------------
* null or empty text: scored like a text of padding only; null doc_id: scored, and not held out;
* no usable label, or labels of one class only: every score is the share of good labels (0.5 without any);
* a doc_id labelled both ways isn't learned from; a repeated doc_id is scored row by row, equal texts score equally;
* very long texts: bytes are taken in segments, a few numbers per 64 bytes are kept; empty table: empty result;
* further columns, however named, are ignored (`keep_good` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common

SAMPLE, SAMPLE_BYTES, THRESHOLD = 4000, 16 << 20, 0.7
FILTERS, WIDTH, BLOCK = 8, 4, 64
#: How far back a repetition is looked for, and how many bytes it takes.
REACH, GRAM = 32, 8
SEGMENT = 1 << 18
EPOCHS, BATCH, RATE, SEED = 14, 128, 0.03, 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def blocks_of(size: int) -> int:
    return max(1, -(-size // BLOCK))


def repeats(b: np.ndarray) -> np.ndarray:
    """1 where the eight bytes up to here have also stood 2 to 31 bytes before."""
    n = len(b)
    out = np.zeros(n, bool)
    if n > GRAM:
        raw = np.ascontiguousarray(b)
        gram = np.ndarray((n - GRAM + 1,), "<u8", raw.data, strides=(1,)).copy()  # overlapping views of 8 bytes
        hit = np.zeros(len(gram), bool)
        for lag in range(2, REACH):
            if lag < len(gram):
                hit[lag:] |= gram[lag:] == gram[:-lag]
        hit &= gram != 0
        out[GRAM - 1 :] = hit
    return out


def laid_out(raw: bytes, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at..to with WIDTH - 1 more, zeros beyond the end; and where they repeat."""
    first = max(0, at - REACH - GRAM)
    b = np.zeros(to - first + WIDTH - 1, np.uint8)
    part = np.frombuffer(raw, np.uint8, min(len(raw), to + WIDTH - 1) - first, first) if len(raw) > first else b[:0]
    b[: len(part)] = part
    again = repeats(b)
    return b[at - first :], again[at - first : to - first]


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    stutter: np.ndarray  # FILTERS
    bias: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS
    peak: np.ndarray  # FILTERS
    base: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.filters.astype(np.float32)
        pair = lambda i: (w[i][:, None, :] + w[i + 1][None, :, :]).reshape(65536, -1)
        return pair(0), pair(2)

    def responses(self, b: np.ndarray, again: np.ndarray, tables) -> np.ndarray:
        """position x filter."""
        pairs = (b[:-1].astype(np.uint16) << 8) | b[1:]
        n = len(again)
        z = np.take(tables[0], pairs[:n], axis=0)
        z += np.take(tables[1], pairs[2 : n + 2], axis=0)
        on = np.flatnonzero(again)
        if len(on):
            z[on] += self.stutter.astype(np.float32)
        return z

    def pooled(self, raw: bytes, tables) -> np.ndarray:
        """The largest response of each block of 64 bytes, over the whole text."""
        total = blocks_of(len(raw)) * BLOCK
        parts = []
        for at in range(0, total, SEGMENT):
            b, again = laid_out(raw, at, min(total, at + SEGMENT))
            parts.append(self.responses(b, again, tables).reshape(-1, BLOCK, FILTERS).max(axis=1))
        return np.concatenate(parts)

    def chunks(self, blocks: np.ndarray) -> np.ndarray:
        """Activations of the overlapping chunks, two blocks each."""
        top = np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
        return np.maximum(top + self.bias.astype(np.float32), 0)

    def score(self, text: str | None, tables) -> float:
        h = self.chunks(self.pooled((text or "").encode(), tables))
        z = float(h.mean(axis=0, dtype=np.float64) @ self.mean + h.max(axis=0) @ self.peak + self.base)
        return 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))


def train(rows: list[tuple[str | None, int]]) -> Network | float:
    """Fits all parameters together, by gradient steps of shuffled batches; or the share of good labels."""
    good = sum(q for _, q in rows)
    if not rows or good in (0, len(rows)):
        return good / len(rows) if rows else 0.5
    rng = np.random.default_rng(SEED)
    share = good / len(rows)
    p = {
        "filters": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)),
        "stutter": rng.normal(0.3, 0.3, FILTERS),
        "bias": np.zeros(FILTERS),
        "mean": rng.normal(0, 0.5, FILTERS),
        "peak": rng.normal(0, 0.1, FILTERS),
        "base": np.array(float(np.log(share / (1 - share)))),
    }
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    docs = []
    for text, label in rows:
        raw = (text or "").encode()
        b, again = laid_out(raw, 0, blocks_of(len(raw)) * BLOCK)
        docs.append((b, again, label))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(order), BATCH):
            net = Network(**p)
            tables = net.tables()
            g = {n: np.zeros_like(x) for n, x in p.items()}
            batch = order[k : k + BATCH]
            for i in batch:
                b, again, label = docs[i]
                z = net.responses(b, again, tables).reshape(-1, BLOCK, FILTERS)
                at = z.argmax(axis=1)
                blocks = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :]
                at += np.arange(len(blocks))[:, None] * BLOCK
                if len(blocks) > 1:
                    right = blocks[1:] > blocks[:-1]
                    where = np.where(right, at[1:], at[:-1])
                else:
                    where = at
                h = net.chunks(blocks)
                mean, peak = h.mean(axis=0), h.max(axis=0)
                out = 1 / (1 + np.exp(-(mean @ p["mean"] + peak @ p["peak"] + p["base"])))
                err = (out - label) / len(batch)
                g["base"] += err
                g["mean"] += err * mean
                g["peak"] += err * peak
                grad = np.broadcast_to(err * p["mean"] / len(h), h.shape).copy()
                top = h.argmax(axis=0)
                grad[top, np.arange(FILTERS)] += err * p["peak"]
                grad[h <= 0] = 0
                g["bias"] += grad.sum(axis=0)
                g["stutter"] += (grad * again[where]).sum(axis=0)
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                for j in range(WIDTH):
                    np.add.at(g["filters"][j], (b[where + j], f), grad)
            step += 1
            for n in p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return Network(**{k: x if x.ndim else float(x) for k, x in p.items()})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """Trains on labelled rows that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sure = usable.groupBy("doc_id").agg(F.min("quality").alias("__q"), F.max("quality").alias("__most")).where("__q = __most")
    chosen = sure.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__doc"), "__q")
    # at most `sample` rows of two numbers are broadcast; a doc_id that repeats gives one text
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc"))
    sizes = texts.groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).where(F.col("size") <= SAMPLE_BYTES)
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id")  # numbers of `sample` rows
    within = sizes.withColumn("__upto", F.sum("size").over(order)).where(F.col("__upto") <= SAMPLE_BYTES).select(F.col("doc_id").alias("__in"))
    rows = texts.join(F.broadcast(within), F.col("doc_id") == F.col("__in")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__q").alias("q")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([(r["text"], int(r["q"] != 0)) for r in rows])


def scored(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id, text_id (a hash of the text), score; every byte of every row counts."""
    rows = docs.select("doc_id", "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if isinstance(net, Network) else None
        for batch in batches:
            if tables is None:
                score = np.full(batch.num_rows, net, np.float64)
            else:
                score = np.fromiter((net.score(t.as_py(), tables) for t in batch.column(1)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(judge, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all columns."""
    net = learn(docs, labels)
    schema = docs.schema
    at = docs.columns.index("text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if isinstance(net, Network) else None
        for batch in batches:
            good = [(net if tables is None else net.score(t.as_py(), tables)) >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(pick, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.plain_columns(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    net = learn(docs, common.plain_columns(common.table(spark, sf_dir, "labels"), ["doc_id", "quality"]))
    return scored(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

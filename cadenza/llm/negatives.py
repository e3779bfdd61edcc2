"""Hard negatives by one-dimensional distance keys.

Scores are inner products of whole numbers.  Each vector x gets one component more, sqrt(M^2 - |x|^2) with the largest norm M, and an
anchor q gets a zero: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the highest scores are the nearest vectors.  Pivots are fitted to at
most `SAMPLE_BYTES` of vectors (the first in the order of a hash of vec_id); every vector is stored under its nearest pivot, in the
order of (pivot, distance), in blocks of `ROWS` of known pivot and key interval.

A search expands: each block of anchors first scans the blocks around its own key, then, round by round, eight times as many of
those whose key interval meets an annulus that may still hold something.  A vector with key d under a pivot at distance e from
the anchor is |d - e| away at least; once that is more than the distance of an anchor's k-th best for every block left, its top k are
proven and it is done.  The k-th best of the sample is the first such bound, so hardly a vector that can't be among the
results leaves a task.  The first search finds the positives of each anchor; the second finds, for each positive, vectors of other labels
in the annulus between its score and a share of it.

Results in special cases
------------------------
* null vec_id, label or vector, null or non-finite components, vectors of another length than the commonest: no part;
* a repeated vec_id counts once, with its smallest (label, vector); equal scores go to the smaller vec_id;
* fewer candidates than asked for: all of them; an anchor without positives, or a positive without negatives: no row;
* components are whole numbers; sums of their products have to stay under 2^63;
* empty table, or no anchor: empty result; further columns, however named, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

POSITIVES, NEGATIVES, SHARE, EVERY = 5, 5, 80, 100
#: Vectors and anchors of a block, bytes of the sample, pivots at most, blocks of the first round.
ROWS, ANCHORS, SAMPLE_BYTES, PIVOTS, FIRST = 1024, 256, 8 << 20, 64, 4
_NONE, _ALL = -(1 << 62), 1 << 62


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers): one row per vec_id, out of vec_id, label, vector (array of double)."""
    x = F.col("vector")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select("vec_id", "label", "vector").where(F.coalesce(sound, F.lit(False)))
    most = rows.groupBy(F.size("vector").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").first()
    rows = rows.where(F.size("vector") == (most["k"] if most else 0))
    whole = F.transform("vector", lambda c: c.cast("long"))
    one = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), whole.alias("v"))).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exactly: in floating point where no sum can leave 2^53."""
    size = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if size < 2**53 else a @ b.T


@dataclass
class Keys:
    """Pivots in the space with the added component, and the sample they come from."""

    pivots: np.ndarray
    top: float  # M^2
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame) -> Keys:
        norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        size = rows.agg(F.max(norm).alias("top"), F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
        n, dim = size["n"], 1 if size["dim"] is None else size["dim"]
        taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(64, SAMPLE_BYTES // (8 * max(1, dim)))).collect()
        ids, labels = (np.array([r[c] for r in taken], np.int64) for c in ("vec_id", "label"))
        vectors = np.array([r["v"] for r in taken], np.int64).reshape(len(taken), dim)
        out = cls(np.zeros((0, dim + 1)), float(size["top"] or 0) * (1 + 1e-9), ids, labels, vectors)
        x = out.augmented(vectors)
        rng, k = np.random.default_rng(7), int(min(PIVOTS, max(1, n // (2 * ROWS)), len(x)))
        out.pivots = x[rng.choice(len(x), k, replace=False)] if k else x
        for _ in range(6 if k > 1 else 0):  # Lloyd's steps on the sample
            at = out.distances(x).argmin(axis=1)
            for j in range(k):
                if (at == j).any():
                    out.pivots[j] = x[at == j].mean(axis=0)
        return out

    def augmented(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        return np.hstack([v, np.sqrt(np.maximum(self.top - (v * v).sum(axis=1), 0))[:, None]])

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([v.astype(float), np.zeros((len(v), 1))]))

    def reach(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance within which all vectors with at least that score lie (a little more, for rounding); v: anchors, score: anchor x slot."""
        square = (v.astype(float) ** 2).sum(axis=1)[:, None] + self.top - 2.0 * score
        return np.where(score <= _NONE, np.inf, np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-3)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in arrays]


def blocks(rows: DataFrame, keys, dim: int, size: int, anchors: bool) -> DataFrame:
    """Rows in the order of (pivot, distance), in blocks: block, pivot, lo, hi, ids, labels, vectors."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k: Keys = keys.value
        for b in batches:
            v = _vectors(b.column(2), dim)
            d = k.of_anchors(v) if anchors else k.distances(k.augmented(v))
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(v)), at])], names=["vec_id", "label", "v", "pivot", "d"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def made(n: int) -> pd.DataFrame:
            nonlocal number, held
            x = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            mine, held = x.iloc[:n], [x.iloc[n:]] if len(x) > n else []
            number += 1
            return pd.DataFrame([[(part << 32) | number, mine["pivot"].iloc[0], mine["d"].min(), mine["d"].max(), *_packed(mine["vec_id"].to_numpy(), mine["label"].to_numpy(), np.stack(mine["v"].to_numpy()))]], columns=["block", "pivot", "lo", "hi", "ids", "labels", "vectors"])

        for pdf in batches:
            for _, mine in pdf.groupby("pivot", sort=False):
                if held and held[0]["pivot"].iloc[0] != mine["pivot"].iloc[0]:
                    yield made(size)
                held.append(mine)
                while sum(map(len, held)) >= size:
                    yield made(size)
        if held:
            yield made(size)

    at = rows.select("vec_id", "label", "v").mapInArrow(keyed, "vec_id long, label long, v array<long>, pivot int, d double")
    order = ["pivot", "d", "vec_id"]
    return at.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, "block long, pivot int, lo double, hi double, ids binary, labels binary, vectors binary")


def best(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each (anchor, slot), highest score first, ties to the smaller vec_id."""
    order = np.lexsort((vec_id, -score, slot, anchor))
    group = anchor[order] * (slot.max(initial=0) + 1) + slot[order]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[rank < k]


def scored(a: dict, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """anchor, slot, score, vec_id of the candidates in a block that the bounds admit, the first k of each slot."""
    s = products(a["v"], vectors)
    floor, roof = np.maximum(a["lo"], a["least"]), a["hi"]
    fits = (a["labels"][:, None] == labels) if a["same"] else (a["labels"][:, None] != labels)
    fits &= (s >= floor.min(axis=1)[:, None]) & (s <= roof.max(axis=1)[:, None]) & (a["ids"][:, None] != ids)
    i, j = np.nonzero(fits)
    got = s[i, j]
    slots = [(i[here], np.full(here.sum(), t), got[here], ids[j[here]]) for t in range(floor.shape[1]) for here in [(got >= floor[i, t]) & (got <= roof[i, t])]]
    out = tuple(np.concatenate(x) for x in zip(*slots))
    return tuple(x[best(*out, k)] for x in out)


def opened(row: dict, dim: int) -> dict:
    """The arrays of a block of anchors; lo, hi, least: anchor x slot, the scores that count and the k-th best so far."""
    ids = np.frombuffer(row["ids"], np.int64)
    wide = {c: np.frombuffer(row[c], np.int64).reshape(len(ids), -1) for c in ("lo", "hi", "least")}
    return wide | {"ids": ids, "labels": np.frombuffer(row["labels"], np.int64), "v": np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dim), "same": bool(row["same"])}


_ANCHORS = "ablock long, own int, ids binary, labels binary, vectors binary, same boolean, lo binary, hi binary, least binary"
_FOUND = "ablock long, anchor int, slot int, score long, vec_id long"


def search(asked: DataFrame, index: DataFrame, keys, dim: int, k: int) -> DataFrame:
    """ablock, anchor, slot, rank, score, vec_id: the first k vectors of every slot of the anchors in blocks like `_ANCHORS`, proven."""
    header = index.select("block", F.col("pivot").alias("there"), "lo", "hi").withColumnsRenamed({"lo": "from", "hi": "to"})
    found, done, state, rounds = None, None, asked, 0

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block of anchors by pivot: distances to it, how far it looks, and from which distance on."""
        kk: Keys = keys.value
        for pdf in frames:
            for row in pdf.to_dict("records"):
                a = opened(row, dim)
                far = kk.reach(a["v"], np.maximum(a["lo"], a["least"]))
                far = np.where(a["lo"] > a["hi"], -1.0, far).max(axis=1)
                roof = a["hi"].max(axis=1)
                near = np.where(roof >= _ALL, 0.0, kk.reach(a["v"], roof[:, None].astype(np.int64))[:, 0] * (1 - 4e-9) - 4e-3)
                d = kk.of_anchors(a["v"])
                own = int(row["own"])
                yield pd.DataFrame([(row["ablock"], own == p, p, *_packed(d[:, p], far, near), (d[:, p] - far).min(), (d[:, p] + far).max()) for p in range(d.shape[1])], columns=["ablock", "own", "pivot", "d", "far", "near", "least_key", "most_key"])

    @F.pandas_udf("double")
    def apart(d: pd.Series, far: pd.Series, near: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        """The least distance of a block to one of the anchors that it can still serve; null where there is none."""
        out = []
        for dd, ff, nn, l, h in zip(d, far, near, lo, hi):
            dd, ff, nn = (np.frombuffer(x) for x in (dd, ff, nn))
            least = np.maximum(0, np.maximum(l - dd, dd - h)) * (1 - 1e-9) - 1e-3
            serves = (least <= ff) & (dd + h >= nn) & (ff >= 0)
            out.append(float(least[serves].min()) if serves.any() else None)
        return pd.Series(out, dtype=object)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.to_pydict()
            for row in (dict(zip(columns, x)) for x in zip(*columns.values())):
                ids = np.frombuffer(row["b_ids"], np.int64)
                a = opened(row, dim)
                anchor, slot, score, vec_id = scored(a, ids, np.frombuffer(row["b_labels"], np.int64), np.frombuffer(row["b_vectors"], np.int64).reshape(len(ids), dim), k)
                if len(anchor):
                    arrays = [pa.array(np.full(len(anchor), row["ablock"])), pa.array(anchor.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(vec_id)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["ablock", "anchor", "slot", "score", "vec_id"])

    def raised(state: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """The k-th best so far as the least that counts."""
        row = state.iloc[0].to_dict()
        least = opened(row, dim)["least"].copy()
        last = got[got["rank"] == k]
        least[last["anchor"].to_numpy(), last["slot"].to_numpy()] = np.maximum(least[last["anchor"].to_numpy(), last["slot"].to_numpy()], last["score"].to_numpy())
        return pd.DataFrame([row | {"least": least.tobytes()}])

    payload = index.select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("vectors").alias("b_vectors"))
    many = FIRST
    while True:
        sides = state.mapInPandas(bounds, "ablock long, own boolean, pivot int, d binary, far binary, near binary, least_key double, most_key double")
        if not rounds:
            sides = sides.where("own")
        meets = sides.join(header, (F.col("pivot") == F.col("there")) & (F.col("from") <= F.col("most_key")) & (F.col("to") >= F.col("least_key")))
        left = meets.select("ablock", "block", apart("d", "far", "near", "from", "to").alias("apart")).where("apart IS NOT NULL")
        if done is not None:
            left = left.join(done, ["ablock", "block"], "left_anti")
        numbered = left.withColumn("n", F.row_number().over(W.partitionBy("ablock").orderBy("apart", "block"))).where(F.col("n") <= many + 1)
        numbered = common.cut(numbered.select("ablock", "block", "n"))
        pairs = numbered.where(F.col("n") <= many).select("ablock", "block")
        new = pairs.join(state, "ablock").join(payload, "block").mapInArrow(scan, _FOUND)
        every = new if found is None else new.unionByName(found.drop("rank"))
        w = W.partitionBy("ablock", "anchor", "slot").orderBy(F.desc("score"), "vec_id")
        found = common.cut(every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        # bounds only get tighter, so a round over all pivots that left no block out was the last
        if rounds and not numbered.where(F.col("n") > many).limit(1).count():
            break
        done = pairs if done is None else common.cut(done.unionByName(pairs))
        state = common.cut(state.groupBy("ablock").cogroup(found.groupBy("ablock")).applyInPandas(raised, _ANCHORS))
        many, rounds = many * 8, rounds + 1
    return found


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows, anchors: as `usable` makes them.  An anchor's positives are its highest-scoring rows of the same label; negatives of a
    positive are the highest-scoring rows of other labels from `share` hundredths of its score up to its score.
    """
    spark = rows.sparkSession
    rows = common.cut(rows)
    fitted = Keys.fit(rows)
    dim = fitted.vectors.shape[1]
    keys = spark.sparkContext.broadcast(fitted)
    index = common.cut(blocks(rows, keys, dim, ROWS, False))
    own = common.cut(blocks(anchors, keys, dim, ANCHORS, True))

    def least(a: dict, k: int) -> np.ndarray:
        """The k-th best of the sample for each slot."""
        s: Keys = keys.value
        out = np.full(a["lo"].shape, _NONE, np.int64)
        anchor, slot, score, _ = scored(a, s.ids, s.labels, s.vectors, k)
        full = np.flatnonzero((anchor[k - 1 :] == anchor[: len(anchor) - k + 1]) & (slot[k - 1 :] == slot[: len(slot) - k + 1])) + k - 1
        out[anchor[full], slot[full]] = score[full]
        return out

    def asked(row: dict, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> dict:
        row = {"ablock": row.get("block", row.get("ablock")), "own": row.get("pivot", row.get("own")), "same": same} | {c: row[c] for c in ("ids", "labels", "vectors")}
        row |= {"lo": lo.tobytes(), "hi": hi.tobytes(), "least": np.full(lo.shape, _NONE, np.int64).tobytes()}
        return row | {"least": least(opened(row, dim), k).tobytes()}

    def for_positives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                n = len(row["ids"]) // 8
                yield pd.DataFrame([asked(row, np.full((n, 1), _NONE, np.int64), np.full((n, 1), _ALL, np.int64), True, positives)])

    first = common.cut(own.mapInPandas(for_positives, _ANCHORS))
    near = search(first, index, keys, dim, positives)

    def for_negatives(state: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0].to_dict()
        n = len(row["ids"]) // 8
        lo, hi = np.full((n, positives), _ALL, np.int64), np.full((n, positives), _NONE, np.int64)  # nothing fits an empty slot
        at, place, score = got["anchor"].to_numpy(), got["rank"].to_numpy() - 1, got["score"].to_numpy()
        lo[at, place], hi[at, place] = -(-share * score // 100), score
        return pd.DataFrame([asked(row, lo, hi, False, negatives)])

    second = common.cut(first.groupBy("ablock").cogroup(near.groupBy("ablock")).applyInPandas(for_negatives, _ANCHORS))
    hard = search(second, index, keys, dim, negatives)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for b, raw in zip(pdf["block"], pdf["ids"]):
                ids = np.frombuffer(raw, np.int64)
                yield pd.DataFrame({"ablock": b, "anchor": np.arange(len(ids), dtype=np.int32), "anchor_id": ids})

    ids = own.mapInPandas(named, "ablock long, anchor int, anchor_id long")
    positive = near.select("ablock", "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(positive, ["ablock", "anchor", "slot"]).join(ids, ["ablock", "anchor"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))  # noqa: E731  a floor of anything else would be a number
    whole = F.transform("embedding", lambda c: F.when(finite(c), F.floor(256 * c.cast("double")).cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = common.cut(usable(common.table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("vector"))))
    return mine(rows, rows.where(F.col("vec_id") % EVERY == 0))

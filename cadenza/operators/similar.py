"""Exact joins by cosine: vectors in blocks around pivots, and only those pairs of blocks that can hold a near pair.

Each vector belongs to the pivot it makes the smallest angle with; vectors are stored in the order of (pivot, angle) in blocks of bounded
size.  Angles obey the triangle inequality, so two blocks whose pivots are t apart and whose vectors lie at angles [lo, hi] from
them hold no pair nearer than t - hi - hi', lo - t - hi' or lo' - t - hi.  Pairs of pivots that are too far apart are never joined, and of
the rest only pairs of blocks within the bound are.  Pivots are fitted to a bounded sample, so they change what is skipped, not
what is found.

Null ids or vectors, and vectors with null or non-finite components, take no part; zero vectors have no angle, are near nothing, and
are left out.  Vectors have to be of one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import scratch

#: Vectors of a block, bytes of the sample that pivots are fitted to, pivots at most.
ROWS, SAMPLE_BYTES, PIVOTS = 2048, 4 << 20, 256
#: Blocks of a partition.
PART = 8
_SLACK, _EPSILON = 1e-6, 1e-9


def units(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-300)


@dataclass
class Blocks:
    """A table of vectors by blocks (block, pivot, lo, hi, ids, weights, vectors), its flat rows (id, weight, v, pivot, angle) and the pivots."""

    blocks: DataFrame
    rows: DataFrame
    pivots: np.ndarray
    dim: int

    @classmethod
    def of(cls, df: DataFrame, id_: str, vector: str, weight: Column | None = None) -> Blocks:
        """weight: whole numbers, one for each row."""
        spark = df.sparkSession
        scratch(spark)
        v = F.transform(vector, lambda x: x.cast("double"))
        rows = df.select(F.col(id_).cast("long").alias("id"), (F.lit(1) if weight is None else weight).cast("long").alias("weight"), v.alias("v"))
        sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
        rows = rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
        n, dim = size["n"], size["dim"]
        sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(max(64, SAMPLE_BYTES // (8 * dim))).collect()]
        pivots = _fitted(units(np.array(sample, float).reshape(len(sample), dim)), n)
        shared = spark.sparkContext.broadcast(pivots)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                near = np.clip(units(x) @ shared.value.T, -1, 1)
                at = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(np.arccos(near[np.arange(len(x)), at]))], names=["id", "weight", "v", "pivot", "angle"])

        if n <= ROWS:  # one block
            rows = rows.select("*", F.lit(0).alias("pivot"), F.lit(0.0).alias("angle")).checkpoint()
            return cls(_blocked(rows, True), rows, pivots[:1], dim)
        rows = rows.mapInArrow(keyed, "id long, weight long, v array<double>, pivot int, angle double").checkpoint()
        return cls(_blocked(rows, parts=_parts(n)).checkpoint(), rows, pivots, dim)

    def of_rows(self, rows: DataFrame) -> Blocks:
        """Some of the flat rows in blocks of their own."""
        if len(self.pivots) < 2:
            return Blocks(_blocked(rows, True), rows, self.pivots, self.dim)
        return Blocks(_blocked(rows, parts=_parts(rows.count())).checkpoint(), rows, self.pivots, self.dim)

    def pairs(self, other: Blocks, alike: float, both_ways: bool) -> DataFrame:
        """i, j: the pairs of blocks that can hold vectors with a cosine from `alike` on; both_ways: (j, i) as well as (i, j), of one table."""
        return self._product(other, alike, both_ways).select(F.col("block1").alias("i"), F.col("block2").alias("j"))

    def _product(self, other: Blocks, alike: float, both_ways: bool) -> DataFrame:
        """Those pairs with all columns of both blocks, ending in 1 and 2.

        Partitions of the written blocks meet by the product of both tables: a task
        reads one partition of either side from the shared folder, and what no pair can be near in is left before anything moves.  So
        nothing is shuffled, however many pairs there are.
        """
        far = float(np.arccos(np.clip(alike, -1, 1))) + _SLACK
        packed = lambda b, end: b.blocks.select(*[F.col(c).alias(c + end) for c in ("block", "pivot", "lo", "hi", "ids", "weights", "vectors")])
        x, y = packed(self, "1"), packed(other, "2")
        if len(self.pivots) < 2:  # a block on either side
            return x.crossJoin(y)
        t = np.arccos(np.clip(self.pivots @ self.pivots.T, -1, 1))
        np.fill_diagonal(t, 0)
        # a block brings the angles from its pivot to all others
        angles = self.blocks.sparkSession.createDataFrame([(p, row.tolist()) for p, row in enumerate(t)], "pivot1 int, angles array<double>")
        x = x.join(F.broadcast(angles), "pivot1")
        between = F.get("angles", F.col("pivot2"))
        apart = F.greatest(between - F.col("hi1") - F.col("hi2"), F.col("lo1") - between - F.col("hi2"), F.col("lo2") - between - F.col("hi1"))
        near = apart <= far
        return x.join(y.hint("shuffle_replicate_nl"), near if both_ways else near & (F.col("block1") <= F.col("block2")))

    def meet(self, other: Blocks, alike: float, both_ways: bool, f: Callable[..., dict], schema: str) -> DataFrame:
        """f of (same block, ids, weights, vectors, ids, weights, vectors) for each of the `pairs`, as rows."""
        dim, order = self.dim, [c + e for e in "12" for c in ("ids", "weights", "vectors")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in range(b.num_rows):
                    row = {n: b.column(k)[r].as_py() for k, n in enumerate(b.schema.names)}
                    arrays = [np.frombuffer(row[c], np.float64 if c.startswith("v") else np.int64) for c in order]
                    arrays[2], arrays[5] = arrays[2].reshape(-1, dim), arrays[5].reshape(-1, dim)
                    out = f(row["block1"] == row["block2"], *arrays)
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

        return self._product(other, alike, both_ways).select("block1", "block2", *order).mapInArrow(run, schema)


def _fitted(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots: the sample's first, then always the one that is farthest from those before, and a few steps to their groups' middles."""
    k = 1 if 0 < n <= ROWS else int(min(PIVOTS, max(1, n // (ROWS // 8)), len(x)))
    if not k:
        return np.zeros((0, x.shape[1]))
    chosen, near = [0], x @ x[0]
    for _ in range(k - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    pivots = x[chosen].copy()
    for _ in range(3):
        at = (x @ pivots.T).argmax(axis=1)
        for j in range(k):
            mean = x[at == j].sum(axis=0) if (at == j).any() else pivots[j]
            pivots[j] = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > _EPSILON else pivots[j]
    return pivots


def _parts(n: int) -> int:
    """Partitions of n rows: of PART blocks, but four at least, so that small tables keep some tasks busy too."""
    return max(4, -(-n // (PART * ROWS)))


def _blocked(rows: DataFrame, one: bool = False, parts: int = 1) -> DataFrame:
    """one: all rows fit a block."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def made() -> pd.DataFrame:
            nonlocal number, held
            x = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            mine, held = x.iloc[:ROWS], [x.iloc[ROWS:]] if len(x) > ROWS else []
            number += 1
            packed = [mine["id"].to_numpy().tobytes(), mine["weight"].to_numpy().tobytes(), np.stack(mine["v"].to_numpy()).astype(float).tobytes()]
            return pd.DataFrame([[(part << 32) | number, mine["pivot"].iloc[0], mine["angle"].min(), mine["angle"].max(), *packed]], columns=["block", "pivot", "lo", "hi", "ids", "weights", "vectors"])

        for pdf in frames:
            for _, mine in pdf.groupby("pivot", sort=False):
                while held and held[0]["pivot"].iloc[0] != mine["pivot"].iloc[0]:
                    yield made()
                held.append(mine)
                while sum(map(len, held)) >= ROWS:
                    yield made()
        while held:
            yield made()

    order = ["pivot", "angle", "id"]
    # partitions meet in pairs, so their number is by size and not by setting
    x = rows.coalesce(1) if one else rows.repartitionByRange(parts, *order)
    return x.sortWithinPartitions(*order).mapInPandas(cut, "block long, pivot int, lo double, hi double, ids binary, weights binary, vectors binary")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1) + _EPSILON)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """a, b (a < b), cosine: the pairs of rows with a cosine at or over the threshold, which has to be above 0."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be above 0, and 1 at most")
    blocks = Blocks.of(df, key, vector)

    def near(same, ids, _, v, ids2, __, v2):
        s = cosines(v, v2)
        hit = s >= threshold
        if same:
            hit &= ids[:, None] < ids2
        i, j = np.nonzero(hit)
        return {"a": np.minimum(ids[i], ids2[j]), "b": np.maximum(ids[i], ids2[j]), "cosine": s[i, j]}

    return blocks.meet(blocks, threshold, False, near, "a long, b long, cosine double")


def densities(blocks: Blocks, others: Blocks, alike: float) -> DataFrame:
    """id, d: for each row of `blocks` the weights of all rows of `others` that are `alike` or more to it."""

    def near(_, ids, __, v, ___, weights, v2):
        hit = cosines(v, v2) >= alike
        # whole numbers: in floating point where no sum can leave 2^53
        d = (hit.astype(float) @ weights.astype(float)).astype(np.int64) if float(np.abs(weights).sum()) < 2**53 else hit @ weights
        some = np.flatnonzero(d)
        return {"id": ids[some], "d": d[some]}

    parts = blocks.meet(others, alike, True, near, "id long, d long")
    return parts.groupBy("id").agg(F.sum("d").alias("d"))

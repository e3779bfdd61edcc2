"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on the driver to at most `SAMPLE` vectors and `SAMPLE_BYTES` of them (the first in the order of a hash of vec_id); each node
splits its sample at the median of a random projection; the projections of a tree's levels are at right angles.  Every vector
is then sent down every tree.  A query walks all trees through one shared priority queue, nearest side first: crossing a plane
costs the square of the margin, and the sum over a path is at most the squared distance of what lies there.  A side that costs
more than the squared distance of the query's k-th nearest in the sample can hold no nearer vector and is never queued; the
other leaves are opened in the order of cost until they hold `VISIT` times the table's rows (a row counts once per tree).  A
candidate is a vector in an opened leaf of any tree whose leaves of all trees are near enough by that bound.  So clustered vectors need a few leaves only; independent random vectors have no structure to prune by, and `VISIT` is
set for a recall over 0.95 there.

A vector moves once: to its leaf of the first tree.  A query goes, with the leaves it has opened of all trees, to those leaves of
the first tree that hold any of its candidates; which do, is known from the counts of leaf pairs.  There each candidate is
scored once, exactly, in double precision, and only the best few go on, those that the k nearest candidates of the sample
don't beat already.  Leaves that many vectors or queries share are cut into
chunks by a hash, so no group grows with a copy group.

Results in special cases
------------------------
* null vectors or vec_ids, vectors of another length than `dim` (unless given, the commonest, the smaller one on ties), zero vectors, null or non-finite components: no part;
* a repeated vec_id counts once, with its smallest vector; equal vectors have equal scores, and ties go to the smaller vec_id;
* fewer candidates than asked for: all of them; empty table, or no query: empty result;
* further columns, however named, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

NEAREST, EVERY = 5, 50
#: Rows of a leaf, least and most levels (2 ** MAX_DEPTH leaves of a tree bound the tables of leaf pairs, which the driver holds).
TREES, LEAF, MIN_DEPTH, MAX_DEPTH, SAMPLE, SEED = 4, 200, 3, 9, 20_000, 5
VISIT = 1.5
#: Bytes of the sample, which the driver holds and broadcasts.
SAMPLE_BYTES = 16 << 20
#: Vectors and queries of one block.
VECTORS, QUERIES = 4096, 4096
#: Pairs scored at a time.
PAIRS = 65_536


def usable(df: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, v: one row per vec_id."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.select("vec_id", "embedding").where(F.coalesce(sound, F.lit(False)))
    if dim is None:
        most = rows.groupBy(F.size("embedding").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").first()
        dim = most["k"] if most else 1
    return rows.where(F.size("embedding") == dim).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("v"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Forest:
    """Complete binary trees; node k has the children 2k + 1 and 2k + 2."""

    normal: np.ndarray  # tree x node x dim
    cut: np.ndarray  # tree x node
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
        depth = int(min(MAX_DEPTH, sample.shape[1], max(MIN_DEPTH, np.ceil(np.log2(max(1, rows) / leaf)))))
        rng = np.random.default_rng(SEED)
        x = unit(sample)
        nodes = 2**depth - 1
        # a level's nodes share a direction, and a tree's directions are at right angles: what crossing planes costs adds up
        level = np.floor(np.log2(np.arange(1, nodes + 1))).astype(int)
        normal, cut = np.zeros((trees, max(1, nodes), x.shape[1])), np.zeros((trees, max(1, nodes)))
        for t in range(trees):
            normal[t, :nodes] = np.linalg.qr(rng.normal(size=(x.shape[1], depth)))[0].T[level]
        for t in range(trees):
            held = {0: np.arange(len(x))}
            for k in range(nodes):
                mine = held.pop(k)
                p = x[mine] @ normal[t, k]
                if len(mine):
                    cut[t, k] = np.median(p)
                held[2 * k + 1], held[2 * k + 2] = mine[p <= cut[t, k]], mine[p > cut[t, k]]
        return cls(normal, cut, depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """row x tree: the leaf each unit vector falls into."""
        out = np.zeros((len(x), len(self.normal)), np.int64)
        for t in range(len(self.normal)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = (x * self.normal[t][at]).sum(axis=1) > self.cut[t][at]
                at = 2 * at + 1 + side
            out[:, t] = at - (2**self.depth - 1)
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, budget: float, limit: float = np.inf) -> np.ndarray:
        """tree x leaf: those opened for one unit vector; `limit`: the squared distance beyond which nothing is looked for."""
        nodes, seen = 2**self.depth - 1, 0
        out = np.zeros(sizes.shape, bool)
        margin = (self.normal @ x - self.cut).tolist()
        held = sizes.tolist()
        queue = [(0.0, t, 0) for t in range(len(self.normal))]
        while queue and seen < budget:
            cost, t, k = heapq.heappop(queue)
            while k < nodes:
                m = margin[t][k]
                near = 2 * k + 1 + (m > 0)
                if cost + m * m <= limit:
                    heapq.heappush(queue, (cost + m * m, t, 4 * k + 3 - near))
                k = near
            if held[t][k - nodes]:
                out[t, k - nodes] = True
                seen += held[t][k - nodes]
        return out


    def within(self, x: np.ndarray, limit: float) -> np.ndarray:
        """tree x leaf: those that may hold a vector no further than `limit` (squared) from the unit vector x."""
        margin = self.normal @ x - self.cut
        cost = np.zeros((len(margin), 1))
        for level in range(self.depth):
            m = margin[:, 2**level - 1 : 2 ** (level + 1) - 1]
            cost = np.stack([cost + np.where(m > 0, m * m, 0), cost + np.where(m > 0, 0, m * m)], axis=2).reshape(len(m), -1)
        return cost <= limit


def to_sample(x: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors to those of the sample; none to itself."""
    near = x @ sample.T
    near[ids[:, None] == sample_ids] = -np.inf
    return near


def reach(near: np.ndarray, k: int) -> float:
    """The squared distance of the k-th nearest of some, and a rounding margin; infinite if there are fewer."""
    known = near[near > -np.inf]
    return 2 - 2 * float(np.partition(known, len(known) - k)[len(known) - k]) + 1e-9 if len(known) >= k else np.inf


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def best(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int, allowed=None, least: np.ndarray | float = -2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a block for each query.  Copies of a vector are scored once; its k + 1 smallest ids stand for it.

    allowed: gives, for places in v, the (query x place) candidates; all of them otherwise.  least: the cosine that a
    query's candidates must reach, as k vectors elsewhere do.
    """
    order = np.argsort(v_id, kind="stable")
    u, at_first, which = np.unique(v[order], axis=0, return_index=True, return_inverse=True)
    v_id = v_id[order]
    by = np.argsort(which, kind="stable")
    start = np.searchsorted(which[by], np.arange(len(u)))
    place = np.arange(len(by)) - start[which[by]]
    ids = np.full((len(u), k + 1), -1, np.int64)
    there = np.zeros((len(u), k + 1), bool)
    keep = place <= k
    ids[which[by][keep], place[keep]] = v_id[by[keep]]
    there[which[by][keep], place[keep]] = True
    u_norm, q_norm = np.sqrt((u * u).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    rough = (q @ u.T) / u_norm
    if allowed is not None:  # copies lie in the same leaves
        rough[~allowed(order[at_first])] = -np.inf
    # all that reach the (k + 1)-th best, less what the rough product may be off by: ties go on whole, however many
    n = min(k + 1, len(u))
    floor = np.maximum(np.partition(rough, len(u) - n, axis=1)[:, len(u) - n], least * q_norm) - 1e-9 * q_norm
    high = rough >= floor[:, None]
    ends = np.cumsum(high.sum(axis=1))
    out, at = [], 0
    while at < len(q):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        i, j = np.nonzero(high[at:to])
        i += at
        # the same sum for the same pair wherever it is met, so that scores of copies are equal to the bit
        score = np.repeat((q[i] * u[j]).sum(axis=1) / (q_norm[i] * u_norm[j]), k + 1)
        who, found, ok = np.repeat(i, k + 1), ids[j].ravel(), there[j].ravel()
        ok &= found != q_id[who]
        who, found, score = who[ok], found[ok], score[ok]
        order = np.lexsort([found, -score, who])
        who, found, score = who[order], found[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append((q_id[who[keep]], found[keep], score[keep]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = NEAREST, visit: float = VISIT, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (vec_id, v), all vectors (vec_id, v) but its own id.

    Both sides are read several times and should be written before.
    """
    spark = vectors.sparkSession
    queries = vectors if queries is None else queries
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    n = size["n"]
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(4 * (k + 1), min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size["dim"]))))).toArrow()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest.fit(matrix(sample.column("v")), n, trees, leaf)
    leaves = 2**forest.depth
    budget = max(visit * n, trees * (k + 1))  # so few rows are all found
    known, known_ids = unit(matrix(sample.column("v"))), sample.column("vec_id").to_numpy()
    state = spark.sparkContext.broadcast((forest, known, known_ids, forest.leaves(known)))
    kind = vectors.schema["v"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its leaf of each tree."""
        forest = state.value[0]
        for b in batches:
            at = forest.leaves(unit(matrix(b.column("v")))) if b.num_rows else np.zeros((0, trees), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * trees, pa.int32()), pa.array(at.astype(np.int16).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), lists], names=["vec_id", "v", "at"])

    placed = vectors.select("vec_id", "v").mapInArrow(coded, f"vec_id long, v {kind}, at array<short>")
    # leaf pairs of the first and every tree: 4 ** MAX_DEPTH of a tree at most, whatever the rows
    pairs = placed.select(F.get("at", F.lit(0)).alias("first"), F.posexplode("at").alias("tree", "leaf")).groupBy("first", "tree", "leaf").agg(F.count(F.lit(1)).alias("n")).toArrow()
    first, tree, at_leaf, counts = (pairs.column(c).to_numpy().astype(np.int64) for c in ("first", "tree", "leaf", "n"))
    held = np.zeros((trees, leaves), np.int64)
    np.add.at(held, (tree, at_leaf), counts)
    shared = np.zeros((trees, leaves, leaves), bool)
    shared[tree, at_leaf, first] = True

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its opened leaves, as bits, and the leaves of the first tree where its candidates lie."""
        forest, known, known_ids, known_at = state.value
        for b in batches:
            ids, bits, where, bounds = b.column("vec_id").to_numpy(), [], [], []
            x = unit(matrix(b.column("v"))) if b.num_rows else np.zeros((0, known.shape[1]))
            for first in range(0, len(x), 256):
                sims = to_sample(x[first : first + 256], ids[first : first + 256], known, known_ids)
                for q, near_sample in zip(x[first : first + 256], sims):
                    limit = reach(near_sample, k)
                    on, near = forest.search(q, held, budget, limit), forest.within(q, limit)
                    some = np.any([on[t, known_at[:, t]] for t in range(trees)], axis=0) & np.all([near[t, known_at[:, t]] for t in range(trees)], axis=0)
                    bounds.append(reach(near_sample[some], k))  # candidates themselves, so k reach it
                    bits.append(np.packbits(np.stack([on, near])).tobytes())
                    where.append(np.flatnonzero(shared[on].any(axis=0) & np.all([shared[t, near[t]].any(axis=0) for t in range(trees)], axis=0)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(bits, pa.binary()), pa.array(bounds, pa.float64()), pa.array(where, pa.list_(pa.int64()))], names=["query_id", "v", "bits", "bound", "leaves"])

    probes = common.cut(queries.select("vec_id", "v").mapInArrow(opened, f"query_id long, v {kind}, bits binary, bound double, leaves array<long>"))
    asked = np.zeros(leaves, np.int64)
    for r in probes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a number per leaf
        asked[r["leaf"]] = r["n"]
    parts, turns = -(-held[0] // VECTORS), -(-asked // QUERIES)
    # bounded arrays: a number per leaf
    split = F.broadcast(spark.createDataFrame([(i, int(parts[i]), int(turns[i])) for i in np.flatnonzero(asked).tolist()], "leaf long, parts long, turns long"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    key = ["leaf", "chunk", "turn"]
    sides = placed.withColumn("leaf", F.get("at", F.lit(0)).cast("long")).join(split, "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "parts")).select("leaf", "chunk", upto(F.col("turns")).alias("turn"), "vec_id", "v", "at")
    asks = probes.select("query_id", "v", "bits", "bound", F.explode("leaves").alias("leaf")).join(split, "leaf").withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns")).select("leaf", upto(F.col("parts")).alias("chunk"), "turn", "query_id", "v", "bits", "bound")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            raw = np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            on, near = np.unpackbits(raw, axis=1, count=2 * trees * leaves).reshape(-1, 2, trees, leaves).astype(bool).swapaxes(0, 1)
            at = left.column("at").combine_chunks().flatten().to_numpy().reshape(left.num_rows, trees)

            def allowed(places: np.ndarray) -> np.ndarray:
                some, every = np.zeros((len(on), len(places)), bool), np.ones((len(on), len(places)), bool)
                for t in range(trees):
                    some |= on[:, t, at[places, t]]
                    every &= near[:, t, at[places, t]]
                return some & every

            found = best(right.column("query_id").to_numpy(), matrix(right.column("v")), left.column("vec_id").to_numpy(), matrix(left.column("v")), k, allowed, np.maximum(-2, 1 - right.column("bound").to_numpy() / 2))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    found = sides.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.cut(usable(common.plain_columns(common.table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"])))
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))

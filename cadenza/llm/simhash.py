"""Near-duplicate classes by SimHash fingerprints and a binary trie self-join.

Equal fingerprints are one class from the start.  Fingerprints that differ in at most `budget` bits agree wholly on one of
`budget` + 1 blocks of bits, so the trie over all fingerprints is dealt out as subtrees: one for each block and
value.  A task deals a subtree of more than `LEAF` members out again over its remaining bits in the same way, one block after the
other, so what is shuffled doesn't grow by that.  Only a subtree that is too large for a task is dealt out again between tasks; where that
hardly makes it smaller (many copies that differ a little), it is cut into chunks and every two chunks meet.  Nothing is capped.  In each
subtree node pairs are walked together from the root, differing bits add up, and a pair is left as soon as they exceed the
budget, or as soon as all its members are one component already.  A subtree reports a spanning forest of its links, never all
pairs; alternating large-star and small-star rounds over those links give the components.

Results in special cases
------------------------
* null, empty or white-space text: fingerprint zero, linked like any other; fewer words than the shingle: one shingle;
* null doc_id: the row keeps its fingerprint, but its component is null, it links nothing, and `keep_one` keeps it;
* repeated rows and ties: equal texts have equal fingerprints, and component_id is the smallest doc_id of all;
* repeated doc_ids: each row has its own fingerprint and component, and a doc_id by itself links nothing.  `keep_one` removes
  by row, not by doc_id: of each component one row stays, that of the smallest doc_id, then of the smallest hash of its text;
* very long texts: shingles are hashed in blocks, memory is the text and a block; empty table: empty result;
* further columns, however named, are ignored (`keep_one` returns them as they are).

One fingerprint of 64 bits tells texts of a similarity near 0.8 from others only with a budget that no search can prune
by.  `keep_one` therefore takes several fingerprints (lanes) of independent hashes of each shingle and links two documents
that are within the budget in any of them, if all lanes together differ in `TOTAL` bits at most: that sum is what
estimates the similarity.  A bit that half of the hashes set is taken from the smallest hash there, so that fingerprints of few
shingles are as evenly spread as others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS, BUDGET, SEED = 4, 4, 42
#: For whole near-duplicate removal: words in a shingle, fingerprints, and bits that may differ in one of them.
KEEP_WORDS, KEEP_LANES, KEEP_BUDGET = 5, 6, 8
#: Bits that may differ in all lanes together; unrelated texts differ in 192 of them.
TOTAL = 66
#: Members of a subtree that one task joins; a larger one is dealt out again, by chunks if bits made it less than SHRINK times smaller.
SUBTREE, SHRINK = 200_000, 16
#: Members of a subtree that are walked as they are; a larger one is dealt out inside its task.
LEAF = 4_096
#: Links that a file of a round of components holds; there are as many files as cores at least.
LINKS = 65_536
#: Shingles hashed at a time, rows of whole subtrees joined at a time, pairs of rows compared at a time.
HASHES, ROWS, PAIRS = 65_536, 40_000, 65_536
#: Pairs of rows of two nodes up to which they are gathered with those of other nodes; larger nodes, up to PAIRS, are compared as they lie.
GATHERED = 2048


def remixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash out of a hash (the finalizer of SplitMix64); lane 0 is the hash itself."""
    if not lane:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int = WORDS, lanes: int = 1) -> np.ndarray:
    """64 bits for each lane; a bit is set if it is set in over half of the shingles' hashes.  Of several lanes, a tie takes the smallest hash's bit."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know A-Z and ASCII white space only
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return np.zeros(lanes, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    k = min(words, len(begin))
    begin, end = begin[: len(begin) - k + 1], end[k - 1 :]
    counts, least = np.zeros((lanes, 64), np.int64), np.full(lanes, np.iinfo(np.uint64).max)
    for at in range(0, len(begin), HASHES):
        part = zip(begin[at : at + HASHES].tolist(), end[at : at + HASHES].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in part], "<u8")
        for lane in range(lanes):
            mixed = remixed(h, lane)
            counts[lane] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            least[lane] = min(least[lane], mixed.min())
    on = 2 * counts > len(begin)
    if lanes > 1:
        on |= (2 * counts == len(begin)) & np.unpackbits(least.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return np.packbits(on, axis=1, bitorder="little").view("<u8")[:, 0]


def row_id(text: Column) -> Column:
    """With the doc_id, tells rows apart where a doc_id repeats."""
    return F.xxhash64(text, F.lit("row"))


def fingerprints(docs: DataFrame, words: int = WORDS, lanes: int = 1) -> DataFrame:
    """doc_id, row (a hash of the text), fps (the fingerprints as signed longs)."""
    rows = docs.select("doc_id", row_id(F.col("text")).alias("row"), F.col("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words, lanes) for t in batch.column(2)]
            flat = pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * lanes, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "row", "fps"])

    return rows.mapInArrow(hashed, T.StructType([*rows.schema.fields[:2], T.StructField("fps", T.ArrayType(T.LongType()))]))


def parts_of(path: str, budget: int) -> list[tuple[str, int]]:
    """The subtrees below a path: their paths, and the mask of all bits on which their members agree."""
    bits, mask = list(range(63, -1, -1)), 0
    for step in [int(x) for x in path.split(".") if x] + [None]:
        blocks = [b.tolist() for b in np.array_split(np.array(bits), budget + 1)]
        if step is None:
            return [(f"{path}.{k}".lstrip("."), mask | sum(1 << b for b in block)) for k, block in enumerate(blocks) if block]
        mask |= sum(1 << b for b in blocks[step])
        bits = [b for b in bits if not mask >> b & 1]
    raise AssertionError


def dealt(path: str, budget: int) -> Column:
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for p, m in parts_of(path, budget)])


def root_of(label: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = label[i]
        if (up == i).all():
            return i
        i = up


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; label points to smaller members only."""
    while len(i):
        a, b = root_of(label, i), root_of(label, j)
        on = a != b
        i, j = a[on], b[on]
        if len(i):
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))


def walk(group: np.ndarray, fp: np.ndarray, budget: int, lanes: np.ndarray | None = None, total: int = TOTAL) -> np.ndarray:
    """The trie self-join of many subtrees at once: for each row, the first row of its component within its subtree.

    Rows are sorted by group and unsigned fp.  A node is a range of rows; its children part where the next bit turns one, or,
    where all bits are equal, in the middle.  lanes: all fingerprints of each row, if they have a say.
    """
    n = len(fp)
    label = np.arange(n)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    root, turns, stale = label.copy(), np.arange(n), 0

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal stale
        near = (i != j) & (root[i] != root[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        i, j = i[near], j[near]
        if lanes is not None and len(i):
            near = np.bitwise_count(lanes[i] ^ lanes[j]).sum(axis=1, dtype=np.int64) <= total
            i, j = i[near], j[near]
        unite(label, i, j)
        stale += len(i)

    def settle() -> None:
        """Which rows are one component by now, and where that changes in the order of rows."""
        nonlocal root, turns, stale
        label[:] = root_of(label, np.arange(n))
        root, stale = label.copy(), 0
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])

    def compare(pairs: np.ndarray) -> None:
        """All rows of small node pairs against each other."""
        wide, tall = pairs[1] - pairs[0], pairs[3] - pairs[2]
        size = np.cumsum(wide * tall)
        at = 0
        while at < len(size):
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + PAIRS, "right")))
            part = pairs[:, at:to]
            each = (wide * tall)[at:to]
            which = np.repeat(np.arange(to - at), each)
            k = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            join(part[0][which] + k // tall[at:to][which], part[2][which] + k % tall[at:to][which])
            at = to

    def compare_large(pairs: np.ndarray) -> None:
        """All rows of larger node pairs, one pair of nodes at a time."""
        for a, b, x, y in pairs.T.tolist():
            i, j = np.nonzero(np.bitwise_count(fp[a:b, None] ^ fp[None, x:y]) <= budget)
            if len(i):
                join(i + a, j + x)

    # neighbours first: of a dense group most is one component then, and its nodes need no further look
    for gap in (1, 2, 3):
        near = np.flatnonzero(group[gap:] == group[:-gap])
        join(near, near + gap)
    settle()
    # a stack of frontiers, so that a wide one is walked in slices; rows: a from, a to, b from, b to, errors
    top = np.stack([edge[:-1], edge[1:], edge[:-1], edge[1:], np.zeros(len(edge) - 1, np.int64)])
    stack = [(63, top[:, k : k + PAIRS // 4]) for k in range(0, top.shape[1], PAIRS // 4)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, pairs = stack.pop()
        if 4 * stale > n or stale and 4 * pairs.shape[1] > n:
            settle()
        one = (turns[pairs[0]] == turns[pairs[1] - 1]) & (turns[pairs[2]] == turns[pairs[3] - 1]) & (root[pairs[0]] == root[pairs[2]])
        pairs = pairs[:, ~one]
        rows = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        small, large = rows <= GATHERED, (rows > GATHERED) & (rows <= PAIRS)
        if small.any():
            compare(pairs[:4, small])
        if large.any():
            compare_large(pairs[:4, large])
        pairs = pairs[:, rows > PAIRS]
        if not pairs.shape[1]:
            continue
        a, b, x, y, err = pairs
        if depth < 0:  # equal fingerprints, which other lanes may tell apart
            mid, cut, off = (a + b) // 2, (x + y) // 2, 0
        else:
            if depth not in ones:
                ones[depth] = np.concatenate([[0], np.cumsum((fp >> np.uint64(depth)) & np.uint64(1)).astype(np.int64)])
            c = ones[depth]
            mid, cut, off = b - (c[b] - c[a]), y - (c[y] - c[x]), 1
        twin = a == x
        below = np.concatenate(
            [
                np.stack([a, mid, x, cut, err]),
                np.stack([mid, b, cut, y, err]),
                np.stack([a, mid, cut, y, err + off]),
                np.stack([mid, b, x, cut, err + off])[:, ~twin],  # of a node with itself, one order is enough
            ],
            axis=1,
        )
        below = below[:, (below[4] <= budget) & (below[0] < below[1]) & (below[2] < below[3])]
        stack += [(depth - 1, below[:, k : k + PAIRS // 4]) for k in range(0, below.shape[1], PAIRS // 4)]
    return root_of(label, np.arange(n))


def walk_dealt(group: np.ndarray, fp: np.ndarray, budget: int, paths: list[str], lanes: np.ndarray | None = None, total: int = TOTAL) -> np.ndarray:
    """`walk`, with subtrees of more than `LEAF` rows dealt out over the bits that their path leaves open, if that saves comparisons.

    paths: the path of each group, in their order.  A subtree's rows lie together; a link of any of its parts joins them.
    """
    n = len(fp)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    whole, label = np.ones(n, bool), np.arange(n)
    for path, a, b in zip(paths, edge[:-1].tolist(), edge[1:].tolist()):
        if b - a <= LEAF or "/" in path:  # a pair of chunks is one that bits hardly part
            continue
        masks = [np.uint64(m) for _, m in parts_of(path, budget)]
        size = sum(float((np.unique(fp[a:b] & m, return_counts=True)[1].astype(float) ** 2).sum()) for m in masks)
        if 2 * size > float(b - a) ** 2:
            continue
        whole[a:b] = False
        for m in masks:
            part = fp[a:b] & m
            order = np.lexsort([fp[a:b], part]) + a
            first = walk(np.cumsum(np.concatenate([[False], np.diff(part[order - a]) != 0])), fp[order], budget, None if lanes is None else lanes[order], total)
            unite(label, order, order[first])
    rest = np.flatnonzero(whole)
    if len(rest):
        label[rest] = rest[walk(group[rest], fp[rest], budget, None if lanes is None else lanes[rest], total)]
    return root_of(label, np.arange(n))


def links(classes: DataFrame, budget: int = BUDGET, total: int = TOTAL, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) between class ids that keep all components of each lane; classes: id, fps (as many of each as there are lanes)."""
    lanes = F.size("fps") > 1
    # one lane decides alone, and its fingerprint is all that moves
    rows = classes.select("id", F.when(lanes, F.col("fps")).alias("fps"), F.posexplode("fps").alias("lane", "fp"))
    kept = ["lane", "fp", "id", "fps"]
    rows = rows.select(*kept, F.lit(None).cast("long").alias("above"), F.explode(dealt("", budget)).alias("at")).select(*kept, "above", "at.*")
    key = ["lane", "path", "part"]
    small = None
    while True:
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("above"))
        # one row for more than `subtree` members, so one file holds them
        large = common.cut(sizes.where(F.col("n") > subtree).select(*key, "n", (F.col("n") * SHRINK > F.col("above")).alias("dense")).repartition(1))
        paths = [r["path"] for r in large.where("dense IS NULL OR NOT dense").select("path").distinct().collect()]  # at most (budget + 1) ** depth, few in fact
        any_large = bool(paths) or large.limit(1).count() > 0
        calm = (rows.join(large, key, "left_anti") if any_large else rows).select(*key, "fp", "id", "fps")
        small = calm if small is None else small.unionByName(calm)
        if not any_large:
            break
        wide = rows.drop("above").join(large, key)
        # a dense one: every two of its chunks, of half the size that a task may have
        chunks = F.ceil(F.col("n") / (subtree / 2))
        mine = F.pmod(F.xxhash64("id"), chunks)
        other = wide.where("dense").select("*", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other")).withColumn("mine", mine)
        pair = F.concat("path", F.lit("/"), F.least("mine", "other"), F.lit("/"), F.greatest("mine", "other"))
        small = small.unionByName(other.select("lane", pair.alias("path"), "part", "fp", "id", "fps"))
        if not paths:
            break
        below = None
        for p in paths:
            below = F.when(F.col("path") == p, dealt(p, budget)) if below is None else below.when(F.col("path") == p, dealt(p, budget))
        rows = wide.where("dense IS NULL OR NOT dense").select(*kept, F.col("n").alias("above"), F.explode(below).alias("at")).select(*kept, "above", "at.*")
        rows = common.cut(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def forest(t: pa.Table) -> pa.RecordBatch:
            lane, part = t.column("lane").to_numpy(), t.column("part").to_numpy()
            fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("id").to_numpy()
            coded = t.column("path").combine_chunks().dictionary_encode()
            names, path = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            order = np.lexsort([fp, part, path, lane])
            lane, path, part, fp, rep = (x[order] for x in (lane, path, part, fp, rep))
            new = np.concatenate([[False], (lane[1:] != lane[:-1]) | (path[1:] != path[:-1]) | (part[1:] != part[:-1])])
            fps = t.column("fps").combine_chunks()
            more = None if fps.null_count else fps.flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)[order]
            at = np.concatenate([[0], np.flatnonzero(new)])
            first = walk_dealt(np.cumsum(new), fp, budget, [names[k] for k in path[at]], more, total)
            on = first != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[first[on]])], names=["a", "b"])

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            lane, path, part = t.column("lane").to_numpy(), t.column("path"), t.column("part").to_numpy()
            same = (lane == lane[-1]) & (part == part[-1]) & pc.equal(path, path[-1]).to_numpy()
            to = int(len(same) - same[::-1].argmin()) if not same.all() else 0
            if to:  # the last subtree may go on in the next batch
                yield forest(t.slice(0, to))
            rest = t.slice(to)
            held, count = rest.to_batches(), rest.num_rows
        if held:
            yield forest(pa.Table.from_batches(held).combine_chunks())

    dealt_out = small.select(*key, "fp", "id", "fps").repartition(*key).sortWithinPartitions(*key)
    return dealt_out.mapInArrow(joined, "a long, b long")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (smallest node reachable), for all nodes of the edges (a, b) but the smallest of each component.

    The result is cut.  A round writes as many files as its links need, whatever the number of shuffle partitions: each file costs an
    executor several processes (chmod) on a file system without Hadoop's native library.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.cut(e)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-seen[0] // LINKS))
        # large star: all larger neighbours of a node are linked to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(files))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.cut(large.coalesce(files))
        # small star: all smaller neighbours of a node, and itself, are linked to the smallest of them
        least = common.cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(files))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def classified(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, lanes: int = 1, total: int = TOTAL, subtree: int = SUBTREE) -> DataFrame:
    """doc_id, row (a hash of the text), fps, component_id, keeper (the row of the component's smallest doc_id)."""
    found = common.cut(fingerprints(docs, words, lanes))
    first = F.min(F.struct("doc_id", "row")).alias("first")
    classes = found.where(F.col("doc_id").isNotNull()).groupBy("fps").agg(first)
    # ids of their own: one doc_id may have rows in several classes
    classes = common.cut(classes.withColumn("id", F.monotonically_increasing_id()))
    parts = components(links(classes, budget, total, subtree))
    members = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    least = classes.join(members, F.col("id") == F.col("node")).groupBy("component").agg(F.min("first").alias("least"))
    heads = members.join(least, "component").select("node", "least")
    parts = classes.join(heads, F.col("id") == F.col("node"), "left").select(F.col("fps").alias("__fps"), F.coalesce("least", "first").alias("k"))
    # written first: the join then splits a fingerprint that many rows share
    out = found.join(common.cut(parts), F.col("fps") == F.col("__fps"), "left").withColumn("k", F.when(F.col("doc_id").isNotNull(), F.col("k")))
    return out.select("doc_id", "row", "fps", F.col("k.doc_id").alias("component_id"), F.col("k.row").alias("keeper"))


def keep_one(docs: DataFrame, words: int = KEEP_WORDS, budget: int = KEEP_BUDGET, lanes: int = KEEP_LANES, total: int = TOTAL) -> DataFrame:
    """One row of each component, with all columns; rows without doc_id stay."""
    doc, row = common.free_names(docs, "doc", "row")
    sorted_out = classified(docs, words, budget, lanes, total).where(F.col("doc_id").isNotNull())
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("row") == F.col("keeper"))
    keyed = common.cut(sorted_out.groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"))
    here = (docs["doc_id"] == F.col(f"`{doc}`")) & (row_id(docs["text"]) == F.col(f"`{row}`"))
    out = docs.join(keyed.select(doc, row), here, "left_anti")
    again = keyed.where("stays").select(doc, row)
    if again.limit(1).count():  # a row that stays and is there several times: once
        out = out.unionByName(docs.join(again, here, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classified(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")

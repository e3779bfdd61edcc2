"""Robust scores, budgets, shortlists and selections."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors
from ..functions.files import scratch
from . import prefix, similar


def medians(df: DataFrame, keys: list[str], columns: list[str], large: bool | None = None) -> DataFrame:
    """keys and the exact median of each column, under the column's own name.

    large: for groups whose distinct values don't fit one task; by Spark's estimate of the table unless said.  A sketch brackets
    the middle of each group; ranks are counted below the bracket, and only the values inside it, a few thousandths of a group,
    are counted and ordered; all columns go through together.
    """
    if not (prefix.is_large(df) if large is None else large):
        return df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__v")) for c in columns])).alias("__e")
    rows = df.select(*keys, each).select(*keys, "__e.*").where("__v IS NOT NULL")
    at = [*keys, "__c"]
    sketch = F.percentile_approx("__v", F.array(F.lit(0.495), F.lit(0.505)), F.lit(10_000))  # within a ten-thousandth
    bracket = rows.groupBy(*at).agg(sketch.alias("__b")).select(*at, F.col("__b")[0].alias("__lo"), F.col("__b")[1].alias("__hi"))
    # the bounds travel with the counts that belong to them
    ranks = _back(rows, bracket, at).groupBy(*at, "__lo", "__hi").agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("__v") < F.col("__lo"), 1)).alias("__below"))
    inside = _back(rows, ranks, at).where("__v BETWEEN __lo AND __hi").groupBy(*at, "__n", "__below", "__v").agg(F.count(F.lit(1)).alias("__k"))
    upto = F.col("__below") + F.sum("__k").over(W.partitionBy(*at).orderBy("__v"))
    inside = inside.withColumn("__upto", upto)
    first, second = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)  # ranks from 1
    reached = lambda rank: F.min(F.when(F.col("__upto") >= rank, F.col("__v")))
    mid = inside.groupBy(*at).agg(reached(first).alias("__a"), reached(second).alias("__z")).withColumn("__m", (F.col("__a") + F.col("__z")) / 2)
    return mid.groupBy(*keys).agg(*[F.max(F.when(F.col("__c") == c, F.col("__m"))).alias(c) for c in columns])


def with_medians(df: DataFrame, keys: list[str], columns: dict[str, Column], large: bool | None = None) -> DataFrame:
    """Adds the median of each expression over its group, under the name given.

    Small tables take a window over whole groups, which needs no join and shares one exchange with others of the same keys.
    """
    if not (prefix.is_large(df) if large is None else large):
        w = W.partitionBy(*keys)
        return df.withColumns({n: F.median(c).over(w) for n, c in columns.items()})
    x = df.withColumns({f"__of_{n}": c for n, c in columns.items()})
    middle = medians(x, keys, [f"__of_{n}" for n in columns], True).withColumnsRenamed({f"__of_{n}": n for n in columns})
    return _back(df, middle, keys)


def robust_z(df: DataFrame, keys: list[str], columns: list[str], limit: float = 3.0, large: bool | None = None) -> DataFrame:
    """Adds z_<column>: distance from the median over 1.4826 MAD, clipped; 0 where the MAD vanishes.

    Two steps for all columns, medians and then MADs; large: see `medians`.
    """
    large = prefix.is_large(df) if large is None else large
    x = with_medians(df, keys, {f"__med_{c}": F.col(c) for c in columns}, large)
    out = with_medians(x, keys, {f"__mad_{c}": F.abs(F.col(c) - F.col(f"__med_{c}")) for c in columns}, large)
    for c in columns:
        z = (F.col(c) - F.col(f"__med_{c}")) / (1.4826 * F.col(f"__mad_{c}"))
        out = out.withColumn(f"z_{c}", F.when(F.col(f"__mad_{c}") < 1e-9, 0.0).otherwise(F.least(F.lit(limit), F.greatest(F.lit(-limit), z))))
    return out.drop(*[f"__{k}_{c}" for c in columns for k in ("med", "mad")])


def _back(df: DataFrame, aggregate: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return df.crossJoin(F.broadcast(aggregate))  # one row
    there = aggregate.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    return df.join(there, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))).drop(*[f"__key_{k}" for k in keys])


def adaptive_cut(df: DataFrame, keys: list[str], similarity: str, least: float = 0.5, slack: float = 0.25) -> DataFrame:
    """Rows at or over max(least, median of similarities from `least` on, minus slack), with that `cut`."""
    x = with_medians(df, keys, {"__m": F.when(F.col(similarity) >= least, F.col(similarity))})
    x = x.withColumn("cut", F.coalesce(F.greatest(F.lit(least), F.col("__m") - slack), F.lit(least))).drop("__m")
    return x.where(F.col(similarity) >= F.col("cut"))


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: float, large: bool | None = None) -> DataFrame:
    """Rows in rank order while the sum of earlier costs, `spent_before`, is under the budget; the last may overshoot.  See `prefix.running`."""
    return prefix.running(df, keys, order, cost, "spent_before", F.col("spent_before") < budget, large)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group; the order has to be total."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def clip_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """The composite score of clips out of sim, confidence, snr_db, f0_median, rate_wps and duration, within their pool."""
    large = prefix.is_large(df)
    x = with_medians(df, keys, {"__f0": F.col("f0_median"), "__rate": F.col("rate_wps")}, large)
    x = x.withColumns(
        {
            "f0_dev": F.abs(12 * F.log2(F.col("f0_median") / F.col("__f0"))),
            "rate_dev": F.abs(F.log(F.greatest("rate_wps", F.lit(0.1)) / F.greatest("__rate", F.lit(0.1)))),
            "length_fit": -F.greatest(F.lit(0.0), 7 - F.col("duration"), F.col("duration") - 11),
        }
    ).drop("__f0", "__rate")
    x = robust_z(x, keys, ["sim", "confidence", "snr_db", "f0_dev", "rate_dev", "length_fit"], large=large)
    typical = -(F.col("z_f0_dev") + F.col("z_rate_dev")) / 2
    return x.withColumn("score", 0.40 * F.col("z_sim") + 0.20 * F.col("z_confidence") + 0.15 * F.col("z_snr_db") + 0.15 * typical + 0.10 * F.col("z_length_fit"))


def region_rank(df: DataFrame, keys: list[str], similarity: str, snr: str, *tie: str) -> DataFrame:
    """Adds rank_score, 0.6 z(similarity) + 0.4 z(snr), and `place` by it."""
    x = robust_z(df, keys, [similarity, snr]).withColumn("rank_score", F.round(0.6 * F.col(f"z_{similarity}") + 0.4 * F.col(f"z_{snr}"), 6))
    return x.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("rank_score"), *tie))).drop(f"z_{similarity}", f"z_{snr}")


def target_seeds(df: DataFrame, keys: list[str], similarity: str, least: float = 0.45, share: float = 0.8) -> DataFrame:
    """Rows alike enough to a given recording: from `least` on, or, if fewer than three are, from the `share` quantile on."""
    pool = df.groupBy(*keys).agg(F.count(F.when(F.col(similarity) >= least, 1)).alias("__n"), F.percentile(similarity, F.lit(share)).alias("__q"))
    high = F.round(similarity, 9) >= F.round("__q", 9)  # rounded, as the quantile may be a row's own value
    return _back(df, pool, keys).where(F.when(F.col("__n") >= 3, F.col(similarity) >= least).otherwise(high)).drop("__n", "__q")


class AmbiguousSpeaker(ValueError):
    """More than one voice speaks a lot, and nothing says which is meant."""


def speakers(clips: DataFrame, alike: float = 0.5) -> DataFrame:
    """cluster, id: density clusters of clips (id, duration, emb); two clips are one voice if alike, else each its own."""
    return density_clusters(clips, "emb", alike).select("cluster", "id")


def clock(seconds: Column) -> Column:
    """m:ss, cut off, not rounded."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def find_target(clips: DataFrame, anchor: list[float] | None = None, target: list[float] | None = None, pick: int | None = None, alike: float = 0.5) -> DataFrame:
    """One row (n, centroid): the voice wanted among clips (id, source, start, duration, emb).

    The consent recording's embedding decides, else that of a target clip, else the voice picked by number, else the
    voice that dominates; AmbiguousSpeaker lists the voices if none does.
    """
    given = anchor if anchor is not None else target
    if given is not None:
        near = clips.withColumn("__sim", vectors.dot(F.col("emb"), F.array(*[F.lit(float(v)) for v in given])))
        return vectors.centroids(target_seeds(near, [], "__sim"), [], "emb")
    members = speakers(clips, alike).join(clips, "id")
    sums = members.groupBy("cluster").agg(F.sum("duration").alias("d")).orderBy("cluster").collect()  # four rows at most
    total = clips.agg(F.sum("duration")).first()[0]
    if pick is not None and not 1 <= pick <= len(sums):
        raise ValueError(f"pick {pick} is out of range: found {len(sums)} voice(s)")
    shares = [r["d"] / total for r in sums]
    second = shares[1] if len(shares) > 1 else 0.0
    if pick is None and (not shares or shares[0] < 0.6 or (second > 0.2 and shares[0] < 2 * second)):
        said = [[] for _ in sums]
        for r in top(members, ["cluster"], [F.col("id")], 3).withColumn("clock", clock(F.col("start"))).orderBy("cluster", "id").collect():
            said[r["cluster"] - 1].append(f"{r['source']} at {r['clock']}")
        raise AmbiguousSpeaker("\n".join(f"voice {i}: {s:.0%} of the speech, e.g. {', '.join(e)}" for i, (s, e) in enumerate(zip(shares, said), 1)))
    return vectors.centroids(members.where(F.col("cluster") == (pick or 1)), [], "emb")


def diverse_top(df: DataFrame, keys: list[str], k: int, apart: float = 60.0, alike: float = 0.97) -> DataFrame:
    """Greedy choice by score: a clip is taken unless it lies within `apart` seconds of a taken one of its source, or is `alike`.

    Needs pos, source, start, score, emb and the keys; adds `chosen` (1..k).  Without keys all rows are one pool; a null key is a key.
    Rows whose pos, score or emb is null, or whose emb holds a null, take no part; a null source or start lies near nothing, and so
    does a zero vector.

    A round looks at the best `HEAD` rows of each pool that nothing taken so far excludes, which are in order, so what it takes is what
    one scan would take; the next round begins behind them.  Each round takes one row at least, and no task holds more of a pool.
    """
    spark = df.sparkSession
    scratch(spark)
    own = [f"__key{i}" for i in range(max(1, len(keys)))]
    sound = F.col("pos").isNotNull() & F.col("score").isNotNull() & F.forall("emb", lambda x: x.isNotNull())
    pool = df.where(F.coalesce(sound, F.lit(False))).withColumns(dict(zip(own, [F.col(c) for c in keys] or [F.lit(0)])))
    # read in every round; rows are told apart by a number of their own
    pool = pool.withColumns({"__unit": vectors.unit(F.col("emb")), "__id": F.monotonically_increasing_id()}).checkpoint()
    size = max(HEAD, 4 * k)
    light = pool.select(*own, "__id", "pos", "source", F.col("start").cast("double").alias("start"), F.col("score").cast("double").alias("score"), "__unit")
    kind = {c: pool.schema[c].dataType.simpleString() for c in (*own, "pos", "source")}
    renamed = [F.col(c).alias(f"{c}_") for c in own]
    here = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in own))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """A pool's head with what was taken before in __taken: what it takes, and a row that says how far it came."""
        pdf = pdf.sort_values("__n")
        before = pdf["__taken"].iloc[0]
        where, start, unit = pdf["source"].to_numpy(object), pdf["start"].to_numpy(float), np.stack(pdf["__unit"].to_numpy()).astype(float)
        free, new, n, i = np.ones(len(pdf), bool), [], 0 if before is None else len(before), 0
        while n < k and i < len(pdf):
            if free[i]:
                n += 1
                new.append((i, n))
                with np.errstate(invalid="ignore"):
                    near = (np.abs(start - start[i]) < apart) & np.array([w is not None and w == where[i] for w in where])
                free &= ~(near | (unit @ unit[i] > alike))
            i += 1
        group, last = [pdf[c].iloc[0] for c in own], pdf.iloc[-1]
        rows = [(*group, pdf["__id"].iloc[i], None, None, c, False) for i, c in new]
        rows.append((*group, last["__id"], last["pos"], last["score"], None, n < k and len(pdf) == size))
        return pd.DataFrame(rows, columns=[*own, "__id", "__pos", "__score", "chosen", "more"]).astype({"chosen": "Int32"})

    schema = ", ".join(f"{c} {kind[c]}" for c in own) + f", __id long, __pos {kind['pos']}, __score double, chosen int, more boolean"
    taken, rest = None, light.withColumn("__taken", F.lit(None).cast(f"array<struct<source:{kind['source']},start:double,unit:array<double>>>"))
    while True:
        w = W.partitionBy(*own).orderBy(F.desc("score"), "pos", "__id")
        head = rest.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= size)
        out = head.groupBy(*own).applyInPandas(choose, schema).checkpoint()
        new = out.where("chosen IS NOT NULL").select(*renamed, F.col("__id").alias("__id_"), "chosen")
        taken = new if taken is None else taken.unionByName(new)
        end = out.where("more").select(*own, F.col("__id").alias("__last"), "__pos", "__score")
        if not end.limit(1).count():
            break
        one = F.struct("source", "start", F.col("__unit").alias("unit"))
        held = light.join(taken, F.col("__id") == F.col("__id_")).groupBy(*[F.col(f"{c}_") for c in own]).agg(F.collect_list(one).alias("__taken"))
        state = end.join(held, here).select(*renamed, "__last", "__pos", "__score", "__taken").checkpoint()
        behind = (F.col("score") < F.col("__score")) | ((F.col("score") == F.col("__score")) & ((F.col("pos") > F.col("__pos")) | ((F.col("pos") == F.col("__pos")) & (F.col("__id") > F.col("__last")))))
        close = lambda x: F.coalesce((x["source"] == F.col("source")) & (F.abs(x["start"] - F.col("start")) < apart), F.lit(False))
        near = F.exists("__taken", lambda x: close(x) | (vectors.dot(x["unit"], F.col("__unit")) > alike))
        rest = light.join(state, here).where(behind & ~near).select(*light.columns, "__taken")
    found = pool.join(taken, F.col("__id") == F.col("__id_"))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], "chosen")


#: Rows of a pool that one task looks at, at least.
HEAD = 256


def two_stage(df: DataFrame, keys: list[str], k: int, clean: Column, apart: float = 60.0, alike: float = 0.97) -> DataFrame:
    """Twice k diverse clips by score, screened by `clean`, scored again within the survivors' pool, then k of those.

    The survivors are read several times for their medians; the exchange below them is reused, so nothing is persisted.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    pick = lambda x, n: diverse_top(clip_scores(x, keys).withColumn("score", F.round("score", 6)).select(*columns, "score"), keys, n, apart, alike)
    return pick(pick(df, 2 * k).where(clean).select(*columns), k)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """a, b (a < b), cosine: see `similar.similar_pairs`."""
    return similar.similar_pairs(df, key, vector, threshold)


#: A duration in billionths of a second, so that sums of them are exact and rows with equal sums tie.
_BILLIONTHS = 1e9


def density_clusters(clips: DataFrame, vector: str, alike: float = 0.5, rounds: int = 4, least: int = 3) -> DataFrame:
    """Greedy clusters (cluster, medoid, id, duration) of clips (id, duration, a vector).

    Each round takes the row with the most near duration (itself included; the smaller id on ties) and all that are near to it.
    At most `rounds` rounds, while at least `least` rows remain.  Fewer rows from the start are one cluster if they are
    near each other, else each is its own, in the order of ids.  One row a round comes to the driver.

    Densities are computed once; after a round, what its members have added is taken off those that are left.  Rows whose
    vector is null, broken or zero are in no cluster.
    """
    ids = clips.select(F.col("id").cast("long").alias("id"), "duration")
    blocks = similar.Blocks.of(clips, "id", vector, F.round(F.coalesce("duration", F.lit(0.0)) * _BILLIONTHS))
    rows = blocks.rows
    near = lambda v: vectors.cosine(F.col("v"), F.array(*map(F.lit, v))) >= alike
    few = rows.orderBy("id").limit(least).collect()
    if len(few) < least:
        one = len(few) == 2 and rows.where(near(few[0]["v"])).count() == 2
        place = F.lit(1) if one else F.when(F.col("id") == (few[0]["id"] if few else 0), 1).otherwise(2)
        medoid = F.lit(few[0]["id"]) if one else F.col("id")
        return rows.join(ids, "id").select(place.alias("cluster"), medoid.alias("medoid"), "id", "duration")
    if len(blocks.pivots) < 2:
        return _in_one_block(rows, alike, rounds, least).join(ids, "id").select("cluster", "medoid", "id", "duration")
    left, out = rows, None
    d = similar.densities(blocks, blocks, alike).checkpoint()
    for k in range(rounds):
        best = left.join(d, "id").orderBy(F.desc("d"), "id").first()
        # a row is its own neighbour, whatever its vector
        mine = near(best["v"]) | (F.col("id") == best["id"])
        members = left.where(mine)
        found = members.select(F.lit(k + 1).alias("cluster"), F.lit(best["id"]).alias("medoid"), "id")
        out = found if out is None else out.unionByName(found)
        left = left.where(~mine)
        if k + 1 == rounds or len(left.select("id").limit(least).collect()) < least:
            break
        gone = similar.densities(blocks.of_rows(left), blocks.of_rows(members), alike).withColumnRenamed("d", "gone")
        d = left.select("id").join(d, "id").join(gone, "id", "left").select("id", (F.col("d") - F.coalesce("gone", F.lit(0))).alias("d")).checkpoint()
    return out.join(ids, "id").select("cluster", "medoid", "id", "duration")


def _in_one_block(rows: DataFrame, alike: float, rounds: int, least: int) -> DataFrame:
    """cluster, medoid, id of so few rows that they are one block (`similar.ROWS`)."""

    def all_rounds(frames):
        x = pd.concat(list(frames), ignore_index=True).sort_values("id", ignore_index=True)
        near, left, found = similar.cosines(*[np.stack(x["v"].to_numpy()).astype(float)] * 2) >= alike, np.ones(len(x), bool), []
        np.fill_diagonal(near, True)
        weight = x["weight"].to_numpy()
        for k in range(rounds):
            d = np.where(left, (near & left) @ np.where(left, weight, 0), -1)
            best = int(d.argmax())  # rows lie by id, so the smallest wins ties
            mine = left & near[best]
            found.append(pd.DataFrame({"cluster": k + 1, "medoid": x["id"].iloc[best], "id": x["id"][mine]}))
            left &= ~mine
            if left.sum() < least:
                break
        yield pd.concat(found)

    return rows.select("id", "weight", "v").coalesce(1).mapInPandas(all_rounds, "cluster int, medoid long, id long")


def dominant(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: share of the first and second cluster in all duration, and whether the first is the target."""
    total = rows.agg(F.sum("duration").alias("total"))
    share = clusters.groupBy().agg(F.sum(F.when(F.col("cluster") == 1, F.col("duration"))).alias("s1"), F.sum(F.when(F.col("cluster") == 2, F.col("duration"))).alias("s2"))
    x = share.crossJoin(total).select((F.coalesce("s1", F.lit(0)) / F.col("total")).alias("share"), (F.coalesce("s2", F.lit(0)) / F.col("total")).alias("second_share"))
    return x.withColumn("dominant", ~((F.col("share") < 0.6) | ((F.col("second_share") > 0.2) & (F.col("share") < 2 * F.col("second_share")))))

"""Cutting word streams into clips, grouping tokens into words, and measures of pauses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.binding import bound

MIN_CLIP, MAX_CLIP, IDEAL_LOW, IDEAL_HIGH, MIN_GAP, LONG_GAP, LAST_GAP = 4.0, 14.0, 7.0, 10.0, 0.12, 0.25, 1.0

#: Timed words.
WORDS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("start", "end", "logprob")]]))


def cut_points(start: np.ndarray, end: np.ndarray, closes: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of each clip.

    A clip begins after a pause and ends before one.  Sentence ends from 7 s on come first: the first from 10 s on, else the
    last; without any, the first longer pause will do.
    """
    n = len(start)
    before = np.concatenate([[np.inf], start[1:] - end[:-1]]) if n else start
    after = np.concatenate([before[1:], [LAST_GAP]]) if n else start
    begins = np.flatnonzero(before >= MIN_GAP)
    if (np.diff(end) < 0).any():  # words that overlap: the stretch of each start by itself
        best = np.array([_best_end(start, end, closes, after, i) for i in begins], np.int64)
    else:
        best = _best_ends(start, end, closes, after, begins)
    begins, best = begins[best >= 0], best[best >= 0]
    out, k = [], 0
    while k < len(begins):
        out.append((int(begins[k]), int(best[k])))
        k = int(np.searchsorted(begins, best[k], "right"))
    return out


def _best_ends(start: np.ndarray, end: np.ndarray, closes: np.ndarray, after: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The last word of the clip that begins at each of `begins`, or -1, all at once; ends are in order."""
    n, base = len(end), start[begins]

    def reached(length: float, strictly: bool = False) -> np.ndarray:
        """The first word by whose end a clip is this long (or longer than this), by the difference itself."""
        at = np.searchsorted(end, base + length - 1e-6)
        while True:
            inside = at < n
            d = np.where(inside, end[np.minimum(at, n - 1)] - base, np.inf)
            short = d <= length if strictly else d < length
            if not short.any():
                return np.maximum(at, begins)
            at = at + short

    limit = reached(MAX_CLIP, strictly=True)
    stops = np.flatnonzero(closes & (after >= MIN_GAP))
    wide = np.flatnonzero(after >= LONG_GAP)

    def first(of: np.ndarray, low: np.ndarray) -> np.ndarray:
        k = np.searchsorted(of, low)
        found = np.append(of, n)[k]
        return np.where(found < limit, found, -1)

    late = first(stops, reached(IDEAL_HIGH))
    k = np.searchsorted(stops, limit) - 1
    last = np.where(k >= 0, np.append(stops, -1)[k], -1)
    early = np.where(last >= reached(IDEAL_LOW), last, -1)
    open_ = first(wide, reached(MIN_CLIP))
    return np.where(late >= 0, late, np.where(early >= 0, early, open_))


def _best_end(start: np.ndarray, end: np.ndarray, closes: np.ndarray, after: np.ndarray, i: int) -> int:
    """The same for one start, whatever the order of ends: no further than the first word that ends too late."""
    length = end[i:] - start[i]
    over = np.flatnonzero(length > MAX_CLIP)
    k = np.arange(over[0] if len(over) else len(length))
    k = k[(length[k] >= MIN_CLIP) & (after[i + k] >= MIN_GAP)]
    ends = k[closes[i + k] & (length[k] >= IDEAL_LOW)]
    if len(ends):
        late = ends[length[ends] >= IDEAL_HIGH]
        return int(i + (late[0] if len(late) else ends[-1]))
    wide = k[after[i + k] >= LONG_GAP]
    return int(i + wide[0]) if len(wide) else -1


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins (and the last ends) in the flat values, and those values; null is an empty list."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), column.flatten()


def timed(regions: DataFrame) -> DataFrame:
    """Regions (key, texts, long, gap, logprob: arrays of one length) to key and words with start and end; all stays inside the row.

    Batches stay flat Arrow arrays throughout.
    """

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = _lists(b.column("texts"))
            long, gap, logprob = (_lists(b.column(c))[1].to_numpy(zero_copy_only=False) for c in ("long", "gap", "logprob"))
            start = np.zeros(len(long))
            step = long + gap
            for i, j in zip(at[:-1], at[1:]):
                start[i + 1 : j] = np.cumsum(step[i : j - 1]) if j > i else 0.0
            start = np.round(start, 6)
            words = pa.StructArray.from_arrays([texts, pa.array(start), pa.array(np.round(start + long, 6)), pa.array(logprob)], ["text", "start", "end", "logprob"])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(at), words)], ["key", "words"])

    rows = regions.select("key", "texts", "long", "gap", "logprob")
    return rows.mapInArrow(laid, T.StructType([rows.schema["key"], T.StructField("words", WORDS)]))


def clips(regions: DataFrame) -> DataFrame:
    """Regions (key, words: array of struct<text, start, end, logprob>) to clips: key, clip, start, end, text, n_words, confidence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words = _lists(b.column("words"))
            texts = words.field("text")
            start, end, logprob = (words.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "logprob"))
            closes = pc.fill_null(pc.match_substring_regex(texts, r"[.?!]$"), False).to_numpy(zero_copy_only=False).astype(bool)
            rows = [(k, c, lo + i, lo + j) for k, (lo, hi) in enumerate(zip(at[:-1], at[1:])) for c, (i, j) in enumerate(cut_points(start[lo:hi], end[lo:hi], closes[lo:hi]))]
            row, clip, first, last = (np.array([r[n] for r in rows], np.int64) for n in range(4))
            sums = np.concatenate([[0.0], np.cumsum(logprob)])
            said = [" ".join(t or "" for t in texts.slice(i, j - i + 1).to_pylist()) for i, j in zip(first.tolist(), last.tolist())]
            columns = [
                b.column("key").take(pa.array(row)), pa.array(clip, pa.int32()), pa.array(start[first]), pa.array(end[last]), pa.array(said, pa.string()),
                pa.array(last - first + 1, pa.int32()), pa.array(np.exp((sums[last + 1] - sums[first]) / np.maximum(last - first + 1, 1))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "clip", "start", "end", "text", "n_words", "confidence"])

    rows = regions.select("key", "words")
    made = [T.StructField(n, t) for n, t in (("clip", T.IntegerType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("text", T.StringType()), ("n_words", T.IntegerType()), ("confidence", T.DoubleType()))]
    return rows.mapInArrow(cut, T.StructType([rows.schema["key"], *made]))


def grouped_tokens(tokens: Column) -> Column:
    """Tokens (struct<token, start, duration, logprob>) to words: a leading space begins a word unless only marks follow.

    Marks before the first word are dropped, and the first token that is none begins a word in any case; blank tokens are none.
    """
    mark = lambda t: t.rlike(r"^\s*[^\p{L}\p{N}\s]+\s*$")
    begins = lambda t: t.startswith(" ") & ~mark(t)

    def joined(t: Column, starts: Column) -> Column:
        stop = lambda j: F.coalesce(F.get(starts, j + 1), F.size(t))

        def word(at, j):
            part = F.slice(t, at + 1, stop(j) - at)
            end = F.element_at(part, -1)
            return F.struct(
                F.array_join(F.transform(part, lambda x: F.trim(x["token"])), "").alias("text"),
                F.get(part, F.lit(0))["start"].alias("start"),
                (end["start"] + end["duration"]).alias("end"),
                (F.aggregate(part, F.lit(0.0), lambda s, x: s + x["logprob"]) / F.size(part)).alias("logprob"),
            )

        return F.transform(starts, word)

    def grouped(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        first = F.array_min(F.filter(places, lambda i: ~mark(F.get(t, i)["token"])))
        starts = bound(first, lambda f: F.filter(places, lambda i: begins(F.get(t, i)["token"]) | (i == f)))
        return F.when(F.size(t) > 0, bound(F.coalesce(starts, F.array().cast("array<int>")), lambda s: joined(t, s))).otherwise(F.array().cast("array<struct<text:string,start:double,end:double,logprob:double>>"))

    return bound(F.filter(tokens, lambda x: F.trim(x["token"]) != ""), grouped)


def pauses(words: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, n, longest_pause, speech_seconds (word lengths and up to 0.25 s of each gap); words have start and end in seconds."""
    nxt = F.lead("start").over(W.partitionBy(*keys).orderBy(*order))
    gap = (nxt - F.col("end")).alias("gap")
    x = words.select(*keys, "start", "end", gap)
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("longest_pause"),
        F.sum(F.col("end") - F.col("start") + F.coalesce(F.least(F.lit(0.25), F.greatest(F.lit(0.0), "gap")), F.lit(0.0))).alias("speech_seconds"),
    )

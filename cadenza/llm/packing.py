"""Packing of tokenized documents into sequences by length patterns and non-negative least squares.

The driver sees nothing but the histogram of piece lengths (one count per length, `max_tokens` at most).  Lengths
are rounded up to a grid; all patterns of up to `parts` grid lengths that fill a sequence are enumerated; repeat
counts are fitted to the histogram by non-negative least squares and rounded.  A repeat is realised by actual lengths of the
pattern's cells that fill a sequence to the last token, so nothing is lost inside patterns; what is left over is packed by best fit
decreasing, on the histogram as well.  Short pieces fill that up, so patterns leave them alone: of the limits in `FILLERS` the one
that gives the fewest sequences counts.  The plan says, for each length, which stretch of its pieces goes to which
sequences and offset; pieces are numbered within their length by a range-partitioned sort and joined to that plan.

Results in special cases
------------------------
* null or empty text: a document of the end token only; null doc_id: an ordinary value;
* repeated rows: each is a document of its own, with pieces and places of its own;
* documents longer than `max_tokens` are cut into pieces of that length, the last may be shorter; none is dropped;
* ties (equal lengths): taken in the order of doc_id and piece; empty table: empty result;
* very long texts: ids of one document at a time are held as four bytes each; further columns are ignored.
"""

from __future__ import annotations

import json
import logging
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_TOKENS, END_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Words of a generation whose ids a worker remembers; two generations are held.
CACHE_WORDS = 200_000
#: Characters of the texts that are taken together.
CHARS = 1 << 22
GRID, PARTS = 16, 3
#: Pieces shorter than such parts of a sequence are tried as fillers: no pattern takes them, so that they are there for what the patterns leave (0: none is held back).
FILLERS = (16, 8, 32, 0)
#: What a tokenizer has to do for its ids to be those of its words in a row.
BY_WORD = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>")


def tokenizer_file(name: str = VOCABULARY) -> str:
    """Where the vocabulary lies on this machine; called on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of whole texts, four little-endian bytes each.

    The tokenizer drops white space and joins nothing across it, so a text's ids are its words' ids in a row, and
    words may be remembered, in two generations so that frequent ones stay.  To have fewer words, Latin-1 texts are
    lower-cased first, as the tokenizer does, and marks after a letter, where it parts words itself, are set apart.
    Four control characters that str.split() also splits at are left to the tokenizer.  New words of Latin-1 letters alone are
    encoded as one text, which is parted again after the tokens that end a word: each such word has exactly one.
    All this holds for a tokenizer that normalises and splits as `BY_WORD` says; any other encodes whole texts.
    Many texts are taken together: their words are found in one run over the bytes, and only different ones are looked up.
    """

    #: Latin-1 letters in lower case; ASCII marks but the apostrophe, which may begin a piece with letters.
    LETTER = np.isin(np.arange(256), [*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0x100)])
    PLAIN = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+")
    MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))
    SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
    LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old = Tokenizer.from_file(file), {}, {}
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = (steps, splits[:1], rules["model"].get("end_of_word_suffix")) == (BY_WORD[0], [BY_WORD[1]], BY_WORD[2])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def words(cls, text: str) -> list[bytes] | list[str]:
        """Words as Latin-1 bytes, or, of other texts, as they are."""
        if "<|" in text:  # may be a special token
            return text.split()
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        raw = text.lower().encode("latin-1")
        b = np.frombuffer(raw, np.uint8)
        apart = np.flatnonzero(cls.LETTER[b[:-1]] & cls.MARK[b[1:]]) + 1
        return (np.insert(b, apart, 32).tobytes() if len(apart) else raw).split()

    def _learn(self, words: Iterable[str | bytes]) -> None:
        known, old = self.known, self.old
        plain, other = [], []
        for w in words:
            if w in old:
                known[w] = old[w]
            else:
                (plain if isinstance(w, bytes) and self.PLAIN.fullmatch(w) else other).append(w)
        for k in range(0, len(plain), 1024):
            part = plain[k : k + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                ids = ids.tobytes()
                known.update((w, ids[a:b]) for w, a, b in zip(part, [0, *cuts], cuts))
            else:  # a vocabulary without word ends
                other += part
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            texts = [w if isinstance(w, str) else w.decode("latin-1") for w in part]
            for w, got in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                known[w] = array("I", got.ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        words = self.words(text)
        ids = list(map(self.known.get, words))
        missing = [i for i, got in enumerate(ids) if got is None]
        if missing:
            self._learn({words[i] for i in missing})
            for i in missing:
                ids[i] = self.known[words[i]]
        return b"".join(ids)


    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in order, `CHARS` of text at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHARS:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> list[bytes]:
        out, plain, where = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            raw = None
            if self.by_word and "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                with suppress(UnicodeEncodeError):
                    raw = text.encode("latin-1")
            if raw is None:
                out[i] = self(text)
            elif raw:
                plain.append(raw)
                where.append(i)
        if not plain:
            return out
        joined = b"\n".join(plain).translate(self.LOWER)
        b = np.frombuffer(joined, np.uint8)
        blank = self.SPACE[b]
        begins = ~blank
        begins[1:] &= blank[:-1] | (self.LETTER[b[:-1]] & self.MARK[b[1:]])
        begins = np.flatnonzero(begins)
        if not len(begins):
            return out
        solid = ~blank
        offsets = np.append(0, np.cumsum(np.add.reduceat(solid, begins, dtype=np.int32))).astype(np.int32)
        kept = b[solid]
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        different = words.dictionary.to_pylist()
        ids = list(map(self.known.get, different))
        missing = [i for i, got in enumerate(ids) if got is None]
        if missing:
            self._learn([different[i] for i in missing])
            for i in missing:
                ids[i] = self.known[different[i]]
        lengths = np.array(list(map(len, ids)), np.int64) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        at = words.indices.to_numpy()
        each = lengths[at]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[at] - (ends - each), each) + np.arange(ends[-1])]
        # a text's words begin between its first byte and the next one's
        first = np.searchsorted(begins, np.cumsum([0, *(len(x) + 1 for x in plain[:-1])]))
        cuts = np.append(0, ends)[np.append(first, len(begins))].tolist()
        for i, lo, hi in zip(where, cuts, cuts[1:]):
            out[i] = ids[lo:hi].tobytes()
        return out


@lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """One for all tasks of a worker process, which then shares the words it has met."""
    return WordIds(file)


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer=tokenizer_file) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select("doc_id", F.col("text"))
    wide = 4 * max_tokens
    end = np.array([END_ID], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer())
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(ids_of.many(text.as_py() or "" for text in batch.column(1))):
                ids = memoryview(ids + end)
                for k, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    long = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    return rows.mapInArrow(cut_up, T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), *long]))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Least squares |a x - b| over x >= 0 by the active-set method."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    grad = a.T @ b
    for _ in range(rounds):
        free = np.where(on, -np.inf, grad)
        j = int(free.argmax())
        if free[j] <= 1e-7 * max(1.0, float(np.abs(b).max())):
            return x
        on[j] = True
        while True:
            cols = np.flatnonzero(on)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[cols] = s
                break
            low = s <= 0
            old = x[cols]
            step = float((old[low] / np.maximum(old[low] - s[low], 1e-300)).min())
            new = old + step * (s - old)
            x[:] = 0
            x[cols] = np.where(new > 1e-12, new, 0)
            on[cols[new <= 1e-12]] = False
            if not on.any():
                break
        grad = a.T @ (b - a @ x)
    logging.getLogger(__name__).warning("non-negative least squares hasn't settled in %d rounds; the rest is packed by best fit", rounds)
    return x


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS, grid: int = GRID, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, sequences like that): covers the histogram exactly."""
    grid = 1 if max_tokens % grid else grid

    def holding_back(shortest: int) -> list[tuple[tuple[int, ...], int]]:
        fitted = fit({n: k for n, k in histogram.items() if shortest <= n < max_tokens}, max_tokens // grid, grid, parts)
        return filled(histogram, fitted, max_tokens, grid)

    return min((holding_back(max_tokens // part if part else 0) for part in FILLERS), key=lambda p: sum(k for _, k in p))


def fit(histogram: dict[int, int], cells: int, grid: int, parts: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns of grid cells that fill a sequence, and how often each should be taken; the most frequent come first."""
    held = np.zeros(cells + 1)
    for n, k in histogram.items():
        held[-(-n // grid)] += k
    used = [c for c in range(1, cells + 1) if held[c]]
    there = set(used)
    patterns = [p for k in range(1, parts) for p in combinations_with_replacement(used, k) if sum(p) == cells]
    patterns += [(*p, cells - sum(p)) for p in combinations_with_replacement(used, parts - 1) if cells - sum(p) in there and cells - sum(p) >= p[-1]]
    if not patterns:
        return []
    a = np.zeros((cells + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for c in p:
            a[c, j] += 1
    x = nnls(a, held)
    return [(patterns[j][::-1], float(x[j])) for j in np.argsort(-x, kind="stable") if x[j] >= 1]


def exact(pattern: tuple[int, ...], left: dict[int, int], max_tokens: int, grid: int) -> Iterator[tuple[int, ...]]:
    """Lengths of which pieces are left, one of each of the pattern's cells but the last, and whatever fills the sequence to the end."""
    of_cell = [[n for n in range(c * grid, (c - 1) * grid, -1) if left.get(n)] for c in pattern[:-1]]
    for some in product(*of_cell):
        last = max_tokens - sum(some)
        if left.get(last):
            yield (*some, last)


def filled(histogram: dict[int, int], fitted: list[tuple[tuple[int, ...], float]], max_tokens: int, grid: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan out of the fitted repeats, each realised by lengths that fill sequences to the last token, and best fit for what is left over."""
    left = {n: k for n, k in histogram.items() if k}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(max_tokens):
        out.append(((max_tokens,), left.pop(max_tokens)))
    for pattern, times in fitted:
        repeats = int(times + 0.5)
        for these in exact(pattern, left, max_tokens, grid):
            n_seq = min(repeats, *(left[n] // k for n, k in Counter(these).items()))
            if n_seq:
                out.append((these, n_seq))
                repeats -= n_seq
                for n in these:
                    left[n] -= n_seq
            if not repeats:
                break
    lengths = sorted(n for n, k in left.items() if k)
    opened: dict[int, list[list]] = defaultdict(list)  # free tokens -> [lengths, count]
    for n in reversed(lengths):
        count = left[n]
        while count:
            room = min((r for r in opened if r >= n and opened[r]), default=None)
            if room is None:
                each = max_tokens // n
                for these, k in (((n,) * each, count // each), ((n,) * (count % each), 1)):
                    if these and k:
                        opened[max_tokens - sum(these)].append([these, k])
                break
            these, have = opened[room][-1]
            take = min(have, count)
            opened[room][-1][1] -= take
            if have == take:
                opened[room].pop()
            opened[room - n].append([(*these, n), take])
            count -= take
    return out + [(tuple(these), k) for r in sorted(opened) for these, k in opened[r]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length and stretch of its pieces [lo, hi), counted over all lengths in order: the sequence of the first one, and the offset."""
    at: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, k in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, at[n], at[n] + k, sequence, offset))
            at[n] += k
            offset += n
        sequence += k
    before, total = {}, 0
    for n in sorted(at):
        before[n] = total
        total += at[n]
    return pd.DataFrame([(n, lo + before[n], hi + before[n], s, o) for n, lo, hi, s, o in rows], columns=["length", "lo", "hi", "first_sequence", "offset"]).astype("int64")


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer=tokenizer_file) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut_up = common.cut(pieces(docs, max_tokens, tokenizer))
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_tokens rows at most
    plan_rows = places(plan(histogram, max_tokens))
    schema = "length long, lo long, hi long, first_sequence long, offset long"
    # stretches are bounded by the lengths and patterns, whatever the number of documents
    stretches = F.broadcast(spark.createDataFrame(plan_rows, schema) if len(plan_rows) else spark.createDataFrame([], schema))
    numbered = common.globally_indexed(cut_up, [F.col("length"), F.col("doc_id"), F.col("piece")], "__place")
    stretches = stretches.withColumnRenamed("length", "__length")
    here = (F.col("length") == F.col("__length")) & (F.col("__place") >= F.col("lo")) & (F.col("__place") < F.col("hi"))
    out = numbered.join(stretches, here)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("__place") - F.col("lo")).alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))

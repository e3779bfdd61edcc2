"""Pluggable models: what each kind of provider takes and gives, and columns computed by a registered one.

No model is included.  A provider is a factory without arguments, called once per worker process; what it returns is called
once a row.  Its results are checked against the contract of its kind by Spark's types.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each kind gives for a row.
CONTRACTS = {
    "regions": "array<struct<start:double,end:double>>",  # samples, sr
    "transcript": "struct<text:string,words:array<struct<text:string,start:double,end:double,logprob:double>>>",  # samples, sr
    "embedding": "array<double>",  # samples, sr
    "events": "map<string,double>",  # samples, sr
    "speech": "struct<samples:array<double>,sr:int,seconds:double>",  # text, reference samples, reference text, seed, options
    "converted": "struct<samples:array<double>,sr:int,seconds:double>",  # samples, reference samples, sr
    "marked": "struct<samples:array<double>,probability:double,payload:int>",  # samples, sr
    "mark": "struct<probability:double,payload:int>",  # samples, sr
}
#: The payload that says a watermark is ours, the least probability of one, and threads of a model at most.
PAYLOAD, LEAST_PROBABILITY, THREADS = 0x5653, 0.5, 8

_FACTORIES: dict[tuple[str, str], Callable[[], Callable]] = {}
_HANDLES: dict[tuple[str, str], Callable] = {}


class UnknownProvider(KeyError):
    """Nothing of that name is registered for the kind."""


def register(kind: str, name: str, factory: Callable[[], Callable]) -> None:
    if kind not in CONTRACTS:
        raise UnknownProvider(f"unknown kind {kind!r}; known: {', '.join(sorted(CONTRACTS))}")
    _FACTORIES[kind, name] = factory


def column(kind: str, name: str, *inputs: Column, after: Callable | None = None) -> Column:
    """What the provider gives for each row, and what `after` makes of it; null where an input is null."""
    if (kind, name) not in _FACTORIES:
        raise UnknownProvider(f"no {kind} provider {name!r}; known: {', '.join(sorted(n for k, n in _FACTORIES if k == kind)) or 'none'}")
    factory = _FACTORIES[kind, name]

    def handle() -> Callable:
        if (kind, name) not in _HANDLES:
            os.environ.setdefault("OMP_NUM_THREADS", str(min(THREADS, os.cpu_count() or 1)))
            _HANDLES[kind, name] = factory()
        return _HANDLES[kind, name]

    def rows(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = handle()
        whole = (lambda *row: after(model(*row))) if after else model
        for batch in batches:
            yield pd.Series([None if any(v is None for v in row) else whole(*row) for row in zip(*batch)], dtype=object)

    kind_of = T._parse_datatype_string(CONTRACTS[kind])
    if isinstance(kind_of, T.StructType):  # structs come as frames, which an array of one row each avoids

        @F.pandas_udf(T.ArrayType(kind_of))
        def wrapped(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for out in rows(batches):
                yield out.map(lambda v: None if v is None else [v])

        return F.get(wrapped(*inputs), F.lit(0))

    @F.pandas_udf(kind_of)
    def plain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from rows(batches)

    return plain(*inputs)


def embedded(name: str, samples: Column, sr: Column) -> Column:
    """Unit vectors; signals under a second are padded with silence."""
    short = F.greatest(F.lit(0), sr - F.size(samples))
    padded = F.concat(samples.cast("array<double>"), F.array_repeat(F.lit(0.0), short))
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) + 1e-9)
    return column("embedding", name, padded, sr, after=unit)


def marked_ok(mark: Column) -> Column:
    """Whether a watermark is there, and ours."""
    return F.coalesce((mark["probability"] >= LEAST_PROBABILITY) & (mark["payload"] == PAYLOAD), F.lit(False))


def token_cap(words: Column) -> Column:
    """Tokens that speech of so many words may take."""
    return F.floor(12.5 * words / 1.6 * 2.5).cast("int") + 40


# --- WAV -------------------------------------------------------------------------------------------------------


@dataclass
class Layout:
    """Where a WAV file's samples lie, and how."""

    kind: int
    channels: int
    sr: int
    bits: int
    start: int
    frames: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8

    def decoded(self, body: bytes) -> np.ndarray:
        """Samples of whole frames, channels averaged."""
        return _samples(np.frombuffer(body, np.uint8), self.kind, self.bits).reshape(-1, self.channels).mean(axis=1)


def layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """The layout of a PCM or float WAV file, out of the heads of its chunks; `read` gives n bytes from a place on."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            body = read(at + 8, min(length, 40))
            kind, channels, sr, _, _, bits = struct.unpack_from("<HHIIHH", body)
            # extensible: the kind stands in the first bytes of the sub-format
            form = (struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE else kind, channels, sr, bits)
        elif name == b"data":
            if form is None:
                raise ValueError("a WAV file whose samples come before their format")
            return Layout(*form, at + 8, min(length, size - at - 8) // (form[1] * form[3] // 8))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without data")


def parsed_wav(raw: bytes, begin: float = 0.0, seconds: float | None = None) -> tuple[np.ndarray, int]:
    """Samples (channels averaged) and rate of a WAV file's bytes; only the asked stretch is decoded.  Files are read by `sources.audio`."""
    x = layout(lambda at, n: raw[at : at + n], len(raw))
    lo = min(x.frames, int(begin * x.sr))
    hi = x.frames if seconds is None else min(x.frames, lo + int(round(seconds * x.sr)))
    return x.decoded(raw[x.start + lo * x.width : x.start + hi * x.width]), x.sr


def _samples(body: np.ndarray, kind: int, bits: int) -> np.ndarray:
    if kind == 3:
        return body.view("<f4" if bits == 32 else "<f8").astype(np.float64)
    if kind != 1 or bits not in (8, 16, 24, 32):
        raise ValueError(f"WAV of kind {kind} with {bits} bits is not read")
    if bits == 8:
        return (body.astype(np.float64) - 128) / 128
    wide = np.zeros((len(body) * 8 // bits, 4), np.uint8)
    wide[:, 4 - bits // 8 :] = body.reshape(-1, bits // 8)
    return wide.view("<i4")[:, 0] / 2.0**31


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("samples", T.ArrayType(T.DoubleType())), T.StructField("sr", T.IntegerType())])))
def _read(content: pd.Series, begin: pd.Series, seconds: pd.Series) -> pd.Series:
    def one(raw, b, s):
        if raw is None:
            return None
        x, sr = parsed_wav(bytes(raw), 0.0 if pd.isna(b) else b, None if pd.isna(s) else s)
        return [{"samples": x, "sr": sr}]

    return pd.Series([one(*row) for row in zip(content, begin, seconds)], dtype=object)


def read_wav(content: Column, begin: Column | None = None, seconds: Column | None = None) -> Column:
    """samples and sr of a file's bytes, of the stretch asked for alone."""
    none = F.lit(None).cast("double")
    return F.get(_read(content, none if begin is None else begin, none if seconds is None else seconds), F.lit(0))


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, sr: pd.Series) -> pd.Series:
    """16-bit mono files, clipped to full scale."""

    def one(x, rate):
        body = np.rint(np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, int(rate), 2 * int(rate), 2, 16, b"data", len(body))
        return head + body

    return pd.Series([None if x is None else one(x, r) for x, r in zip(samples, sr)], dtype=object)

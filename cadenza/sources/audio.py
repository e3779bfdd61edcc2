"""Recordings on disk: windows of WAV files read by byte ranges, and WAV files written all or none.

`windows` is a scan of the format `cadenza_wav`.  Conditions on path, begin and window reach the reader, which opens only the files and reads
only the bytes that they leave; long files are dealt out over several tasks.  `stretches` reads what a table of (path, begin,
seconds) asks for, again only those bytes.  Neither ever holds a whole recording.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from ..functions import providers
from . import blobs

FORMAT = "cadenza_wav"
#: Seconds of a window, bytes of a task.
WINDOW, SPLIT = 30.0, 64 << 20
_SCHEMA = "path string, sr int, window long, begin double, seconds double, samples array<float>"


class Reading:
    """Byte ranges of one file; `taken` counts what was read."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.file, self.taken = files.open_input_file(path), 0
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(max(0, min(n, self.size - at)))
        self.taken += len(got)
        return got

    def close(self) -> None:
        self.file.close()


def samples_at(read: Reading, layout: providers.Layout, lo: int, hi: int) -> np.ndarray:
    """Samples [lo, hi) of a file, channels averaged."""
    lo, hi = (min(max(0, x), layout.frames) for x in (lo, hi))
    return layout.decoded(read(layout.start + lo * layout.width, (hi - lo) * layout.width))


@dataclass
class Stretch(InputPartition):
    """The windows of a file that begin in [lo, hi) of its bytes."""

    path: str
    lo: int
    hi: int

    def __post_init__(self):
        super().__init__(self.path)


@dataclass
class WavReader(DataSourceReader):
    path: str
    seconds: float
    split: int
    paths: set[str] | None = None
    bounds: list[tuple[str, type, float]] = field(default_factory=list)
    taken: int = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  a name of Spark's
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "path" and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = asked if self.paths is None else self.paths & asked
            elif name in ("begin", "window") and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.bounds.append((name, type(f), f.value))
            elif not isinstance(f, IsNotNull):  # nothing is null
                yield f

    def wanted(self, window: int) -> bool:
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        of = {"window": window, "begin": window * self.seconds}
        return all(tests[kind](of[name], value) for name, kind, value in self.bounds)

    def partitions(self) -> list[Stretch]:
        files, root = blobs.opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(root, recursive=True))
        wav = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".wav") and not f.base_name.startswith(("_", ".")))
        return [Stretch(path, lo, min(size, lo + self.split)) for path, size in wav if self.paths is None or path in self.paths for lo in range(0, max(1, size), self.split)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        files, _ = blobs.opened(self.path)
        read = Reading(files, partition.path)
        try:
            layout = providers.layout(read, read.size)
            each = max(1, round(self.seconds * layout.sr))
            for k in range(-(-layout.frames // each)):
                at = layout.start + k * each * layout.width
                # a window belongs to the task in whose stretch it begins; the header, to the first
                if partition.lo <= at < partition.hi and self.wanted(k):
                    x = samples_at(read, layout, k * each, (k + 1) * each)
                    yield partition.path, layout.sr, k, k * self.seconds, len(x) / layout.sr, x.astype(np.float32).tolist()
        finally:
            self.taken += read.taken
            read.close()


class Wav(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options["path"], float(self.options.get("window", WINDOW)), int(self.options.get("split", SPLIT)))


def windows(spark: SparkSession, path: str, seconds: float = WINDOW, split: int = SPLIT) -> DataFrame:
    """path, sr, window (its number), begin, seconds, samples of all WAV files below a path.

    Filters on path (= and in), window and begin (=, <, <=, >, >=) are the reader's: what they leave out is never read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that take filters
    spark.dataSource.register(Wav)
    return spark.read.format(FORMAT).option("window", seconds).option("split", split).load(path)


def stretches(asked: DataFrame) -> DataFrame:
    """asked (path, begin, seconds, ...) with sr and samples of that stretch alone; null seconds: to the end; null path: null.

    A stretch before the file's begin or beyond its end is cut to what is there, possibly nothing.
    """
    order = asked.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, found, name, read, layout = [], [], None, None, None
            for path, begin, seconds in zip(*(batch.column(order.index(c)).to_pylist() for c in ("path", "begin", "seconds"))):
                if path != name and read is not None:
                    read.close()
                    read = None
                if path is None:
                    rates.append(None)
                    found.append(None)
                    continue
                if read is None:
                    read = Reading(*blobs.opened(path))
                    layout, name = providers.layout(read, read.size), path
                lo = int((begin or 0.0) * layout.sr)
                x = samples_at(read, layout, lo, layout.frames if seconds is None else lo + round(seconds * layout.sr))
                rates.append(layout.sr)
                found.append(x.astype(np.float32))
            if read is not None:
                read.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.int32()), pa.array(found, pa.list_(pa.float32()))], names=[*order, "sr", "samples"])

    schema = StructType([*asked.schema.fields]).add("sr", IntegerType()).add("samples", ArrayType(FloatType()))
    return asked.mapInArrow(cut, schema)


def write_wav(rows: DataFrame, name: Column, samples: Column, sr: Column, path: str) -> None:
    """A 16-bit WAV file for each row below `path`, which must not exist: all of them or none (see `blobs`)."""
    blobs.write_files(rows, name, providers.wav_bytes(samples, sr), path)

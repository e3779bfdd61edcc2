"""Live operators with timers: regions of speech, workers that fall idle, and jobs that wait for the one permit of a machine.

Rows of a key may arrive in any order within the watermark: they are held in state and taken in order of their time once
the watermark has passed them, so a stream gives what one loop over all rows in order gives.  Rows behind the watermark are dropped by
Spark.  A key that waits for nothing holds no state.

Keys share buckets by their hash, and state and timer are a bucket's: a call reads and writes what it holds once, as Arrow, whatever the
number of its rows and keys.  The timer wakes the bucket when the watermark reaches what the first of its keys waits for.

The state lies in RocksDB, which these functions choose for the session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Part of what a checkpoint holds: a stream that goes on from one must have the same.
BUCKETS = 1024


def _packed(frame: pd.DataFrame) -> bytes | None:
    if frame.empty:
        return None
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False).replace_schema_metadata()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes | None) -> list[pd.DataFrame]:
    return [] if held is None else [pa.ipc.open_stream(held).read_pandas()]


class InOrder(StatefulProcessor):
    """Takes the rows of each key of a bucket (at: microseconds, and the numbers `VALUES`) in order of (at, numbers) as the watermark passes them.

    A subclass says what a row does to the state of its key, a tuple of `STATE` or None, and what the mere passing of time does; both
    give rows of output, `OUTPUT` less the key.
    """

    VALUES: tuple[str, ...] = ("value",)
    STATE: tuple[str, ...] = ()
    OUTPUT: tuple[str, ...] = ()

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "timer long, held binary, states binary")

    def row(self, state: tuple | None, at: int, *values) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def passed(self, state: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        """What is due at `now`."""
        raise NotImplementedError

    def due(self, state: tuple) -> int:
        """When the state has something to do next."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._on(key, [pdf[["key", "at", *self.VALUES]] for pdf in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._on(key, [], timerValues.getCurrentWatermarkInMs())

    def _on(self, bucket: tuple, new: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        if bucket[0] < 0:  # the null key has a bucket of its own
            new = [pdf.assign(key=0) for pdf in new]
        now, out = watermark * 1000, []
        timer, held, packed = self.kept.get() or (None, None, None)
        states = {k: tuple(state) for pdf in _unpacked(packed) for k, *state in zip(*(pdf[c].tolist() for c in pdf))}
        rows = pd.concat([*_unpacked(held), *new] or [pd.DataFrame(columns=["key", "at"])], ignore_index=True)
        reached = rows["at"] <= now
        first = rows[reached]
        if len(first):
            first = first.sort_values(["at", *self.VALUES])
            for k, at, *values in zip(*(first[c].tolist() for c in ("key", "at", *self.VALUES))):
                state, made = self.passed(states.get(k), at)
                state, more = self.row(state, at, *values)
                states[k] = state
                if made or more:
                    out += [(k, *r) for r in (*made, *more)]
        ahead = {}
        for k, state in states.items():
            state, made = self.passed(state, now)
            out += [(k, *r) for r in made]
            if state is not None:
                ahead[k] = state
        # all of it is written anew: what is held is no more than the watermark's delay
        later = rows[~reached] if len(first) else rows
        waits = [int(later["at"].min())] if len(later) else []
        waits += map(self.due, ahead.values())
        # a timer that isn't ahead of the watermark would never ring
        wake = max(watermark + 1, -(-min(waits) // 1000)) if waits else None
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is None:
            self.kept.clear()
        else:
            if timer != wake:
                self.handle.registerTimer(wake)
            self.kept.update((wake, _packed(later), _packed(pd.DataFrame([(k, *state) for k, state in ahead.items()], columns=["key", *self.STATE]))))
        if out:
            made = pd.DataFrame(out, columns=[self.key, *self.OUTPUT])
            yield made.assign(**{self.key: None}) if bucket[0] < 0 else made

    def close(self) -> None:
        pass


class Regions(InOrder):
    STATE = ("begin", "end", "parts")
    OUTPUT = ("opened", "closed")

    def __init__(self, key: str, threshold: float, frame: float, silence: float, least: float, most: float):
        super().__init__(key)
        self.threshold = threshold
        self.frame, self.silence, self.least, self.most = (round(x * 1e6) for x in (frame, silence, least, most))

    def row(self, state, at, value):
        if math.isnan(value):  # the end of the source
            return None, self._rest(state)
        if value < self.threshold:
            return state, []
        begin, end, parts = state or (at, at, 0)
        end, out = max(end, at + self.frame), []
        while end - begin > (parts + 1) * self.most:
            out.append((begin + parts * self.most, begin + (parts + 1) * self.most))
            parts += 1
        return (begin, end, parts), out

    def passed(self, state, now):
        if state is None or now < state[1] + self.silence:
            return state, []
        return None, self._rest(state)

    def _rest(self, state):
        if state is None or state[1] - state[0] < self.least:
            return []
        return [(state[0] + state[2] * self.most, state[1])]

    def due(self, state):
        return state[1] + self.silence


class Idle(InOrder):
    VALUES = ()
    STATE = ("first", "last", "n")
    OUTPUT = ("opened", "dropped", "n")

    def __init__(self, key: str, idle: float):
        super().__init__(key)
        self.idle = round(idle * 1e6)

    def row(self, state, at):
        first, _, n = state or (at, at, 0)
        return (first, at, n + 1), []

    def passed(self, state, now):
        # idle for longer than the limit, as against just as long
        return (state, []) if state is None or now <= state[1] + self.idle else (None, [(state[0], state[1] + self.idle, state[2])])

    def due(self, state):
        return state[1] + self.idle + 1


class Queue(InOrder):
    """A row's number is its job; how long it takes comes with it."""

    VALUES = ("job", "took")
    STATE = ("free",)
    OUTPUT = ("job", "arrived", "begun", "finished")

    def row(self, state, at, job, took):
        begun = at if state is None else max(at, state[0])
        return (begun + took,), [(job, at, begun, begun + took)]

    def passed(self, state, now):
        # once the permit is free, it doesn't matter since when
        return (None if state is None or state[0] <= now else state), []

    def due(self, state):
        return state[0]


def _run(stream: DataFrame, key: str, ts: str, delay: str, processor: StatefulProcessor, columns: list, schema: str) -> DataFrame:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int").alias("bucket")
    kind = stream.schema[key].dataType
    # pandas would make floats of whole numbers beside a null
    whole = F.coalesce(F.col(key), F.lit(0)) if isinstance(kind, IntegralType) else F.col(key)
    rows = stream.withWatermark(ts, delay).select(bucket, whole.alias("key"), F.col(ts).alias("__ts"), F.unix_micros(F.col(ts)).alias("at"), *columns)
    return rows.groupBy("bucket").transformWithStateInPandas(processor, f"{key} {kind.simpleString()}, {schema}", "append", "eventTime")


def speech_regions(frames: DataFrame, key: str, ts: str, probability: str, delay: str, frame: float, threshold: float = 0.5, silence: float = 0.3, least: float = 0.25, most: float = 20.0) -> DataFrame:
    """key, opened, closed (microseconds) of regions of speech in a stream of frames, with the rules of `ledger.regions`.

    A null probability is the end of a source: its last region is closed then, as there is nothing more to wait for.
    """
    value = F.coalesce(F.col(probability).cast("double"), F.lit(float("nan"))).alias("value")
    return _run(frames, key, ts, delay, Regions(key, threshold, frame, silence, least, most), [value], "opened long, closed long")


def dropped(uses: DataFrame, key: str, ts: str, delay: str, idle: float = 900.0) -> DataFrame:
    """key, opened, dropped (microseconds), n: workers that haven't been used for longer than `idle` seconds, as soon as the watermark shows it."""
    return _run(uses, key, ts, delay, Idle(key, idle), [], "opened long, dropped long, n long")


def queued(jobs: DataFrame, key: str, ts: str, delay: str, job: str, took: str) -> DataFrame:
    """key, job, arrived, begun, finished (microseconds): jobs of a machine run one at a time, in order of (arrival, job); took: microseconds."""
    columns = [F.col(job).cast("long").alias("job"), F.col(took).cast("long").alias("took")]
    return _run(jobs, key, ts, delay, Queue(key), columns, "job long, arrived long, begun long, finished long")

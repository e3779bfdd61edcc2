from __future__ import annotations

import datetime
import random

import pandas as pd
from pyspark.sql.streaming.stateful_processor import TimerValues

from cadenza.plans import catalogue
from cadenza.streaming import ledger, live

BASE = datetime.datetime(2025, 3, 1)
MICRO = int(BASE.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)


def at(seconds):
    return BASE + datetime.timedelta(microseconds=round(seconds * 1e6))


def through(spark, tmp_path, rows, schema, make, batches=4, shuffle=0.0):
    """What the stream gives when rows come in files, each up to `shuffle` seconds out of order, and time goes on after them."""
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: (r[1], rng.random()))
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, shuffle)))
    size = -(-len(late) // batches)
    parts = [late[k : k + size] for k in range(0, len(late), size)]
    parts += [[(-1, at(10_000 + 1000 * k), *([None] * (len(rows[0]) - 2)))] for k in range(2)]  # another key brings the clock on
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"live_{tmp_path.name}"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted(tuple(r) for r in spark.table(name).collect() if r[0] != -1)


def loop_of_regions(frames, frame, silence, least, most):
    """One source after the other, frame by frame."""
    out = []
    for key in sorted({k for k, *_ in frames}):
        begin = end = None
        found = []
        for t, p in sorted((round((ts - BASE).total_seconds() * 1e6), p) for k, ts, p in frames if k == key and p is not None):
            if p < 0.5:
                continue
            if begin is not None and t - end < silence * 1e6:
                end = max(end, t + round(frame * 1e6))
            else:
                found += [(begin, end)] if begin is not None else []
                begin, end = t, t + round(frame * 1e6)
        found += [(begin, end)] if begin is not None else []
        for b, e in found:
            if e - b >= least * 1e6:
                while e - b > most * 1e6:
                    out.append((key, MICRO + b, MICRO + b + round(most * 1e6)))
                    b += round(most * 1e6)
                out.append((key, MICRO + b, MICRO + e))
    return sorted(out)


def test_regions_of_a_stream_a_table_and_a_loop(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for key in range(5):
        t = 0.0
        while t < 90:
            speech = rng.random() < 0.6
            for _ in range(rng.choice([1, 2, 3, 10, 60, 300])):  # runs under a quarter of a second, and over twenty
                rows.append((key, at(t), rng.uniform(0.5, 1) if speech else rng.uniform(0, 0.49)))
                t += 0.1
            t += rng.choice([0, 0, 0.2, 0.3, 0.5])
    rows += [(1, at(1.0), 0.9), (1, at(1.0), 0.9)]  # repeated frames
    schema = "source int, at timestamp, p double"
    want = loop_of_regions(rows, 0.1, 0.3, 0.25, 20.0)
    assert len(want) > 20 and max(e - b for _, b, e in want) == 20_000_000
    table = spark.createDataFrame([*rows, (3, None, 0.9), (None, at(1), 0.9), (3, at(2), None)], schema)
    for bucket in (0.7, 7.0, 3600.0):
        got = ledger.regions(table, ["source"], "at", "p", 0.1, bucket=bucket)
        assert sorted(tuple(r) for r in got.collect()) == want, bucket
    assert through(spark, tmp_path, rows, schema, lambda s: live.speech_regions(s, "source", "at", "p", "2 seconds", 0.1), shuffle=1.9) == want


def test_the_end_of_a_source_closes_its_region(spark, tmp_path):
    """Without waiting for silence: the end marker alone, and no other key's clock."""
    schema = "source int, at timestamp, p double"
    rows = [(1, at(k / 10), 0.9) for k in range(20)] + [(1, at(2.0), None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.speech_regions(stream, "source", "at", "p", "0 seconds", 0.1).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert [tuple(r) for r in spark.table("ended").collect()] == [(1, MICRO, MICRO + 2_000_000)]


def test_workers_are_dropped_when_idle(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], [0.0] * 4
    for _ in range(60):
        w = rng.randrange(4)
        t[w] += rng.choice([1, 100, 899, 900, 901, 2000])
        rows.append((w, at(t[w] / 3), None))  # thirds, so that all lies before the clock goes on
    want = []
    for w in range(4):
        times = sorted(round((ts - BASE).total_seconds() * 1e6) for k, ts, _ in rows if k == w)
        run = []
        for x in times:
            if run and x > run[-1] + 300_000_000:
                want.append((w, MICRO + run[0], MICRO + run[-1] + 300_000_000, len(run)))
                run = []
            run.append(x)
        want.append((w, MICRO + run[0], MICRO + run[-1] + 300_000_000, len(run)))
    got = through(spark, tmp_path, rows, "worker int, at timestamp, note string", lambda s: live.dropped(s, "worker", "at", "60 seconds", 300.0), shuffle=59)
    assert got == sorted(want) and len(want) > 8


def test_one_job_runs_at_a_time(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), at(rng.randrange(0, 3000)), k, rng.choice([1, 30, 400]) * 1_000_000) for k in range(80)]
    want = []
    for m in range(3):
        free = 0
        for ts, job, took in sorted((round((ts - BASE).total_seconds() * 1e6), j, took) for k, ts, j, took in rows if k == m):
            begun = max(ts, free)
            free = begun + took
            want.append((m, job, MICRO + ts, MICRO + begun, MICRO + free))
    schema = "machine int, at timestamp, job long, took long"
    got = through(spark, tmp_path, rows, schema, lambda s: live.queued(s.fillna(0, ["job", "took"]), "machine", "at", "60 seconds", "job", "took"), shuffle=59)
    assert got == sorted(want)
    for m in range(3):
        runs = sorted((b, f) for k, _, _, b, f in got if k == m)
        assert all(f <= b for (_, f), (b, _) in zip(runs, runs[1:]))


class Counted:
    """A handle, and the one value and timer of its bucket, that count what is asked of them."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def _called(self):
        self.calls += 1

    def get(self):
        self._called()
        return self.value

    def update(self, value):
        self._called()
        self.value = value

    def clear(self):
        self._called()
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self._called()
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self._called()
        self.timers.remove(at)


def test_calls_to_state_do_not_grow_with_keys_and_rows():
    """One bucket of one machine and one of 700: as many reads and writes, and the jobs of a loop."""
    calls = []
    for machines, jobs in ((1, 1), (700, 9)):
        rng, handle, queue = random.Random(4), Counted(), live.Queue("machine")
        queue.init(handle)
        rows = [(m, rng.randrange(1, 1_000_000_000), m * jobs + j, rng.randrange(1, 400_000_000)) for m in range(machines) for j in range(jobs)]
        rng.shuffle(rows)
        got = []
        for k, watermark in enumerate((0, 500_000, 1_000_000, 10_000_000)):
            part = pd.DataFrame([r for r in rows if k < 2 and (r[1] > 500_000_000) == (k == 1)], columns=["key", "at", "job", "took"])
            clock = TimerValues(currentWatermarkInMs=watermark)
            frames = queue.handleInputRows((5,), iter([part]), clock) if len(part) else queue.handleExpiredTimer((5,), clock, None)
            got += [tuple(r) for frame in frames for r in frame.itertuples(index=False)]
            assert len(handle.timers) <= 1 and all(t > watermark for t in handle.timers)
        want, free = [], {}
        for m, at_, job, took in sorted(rows):
            begun = max(at_, free.get(m, 0))
            free[m] = begun + took
            want.append((m, job, at_, begun, free[m]))
        assert sorted(got) == sorted(want) and handle.value is None and not handle.timers
        calls.append(handle.calls)
    assert calls[1] <= calls[0] + 4  # a timer set anew or not


def test_slices_of_many_files_and_of_few_rows(spark):
    """Ten files a slice, but one row in the second; nobody's uses are a worker of their own, and spoil no number beside them."""
    rng = random.Random(11)
    workers = [None, 2**60 + 1, *range(2**60 + 40, 2**60 + 90)]
    rows = [(rng.choice(workers), at(low + rng.randrange(2700))) for low in (0, 7300) for _ in range(300)] + [(3, at(0)), (None, at(5000)), (3, at(10_000))]
    want, runs = [], {}
    for w, ts in sorted(rows, key=lambda r: r[1]):
        t = MICRO + round((ts - BASE).total_seconds() * 1e6)
        if w in runs and t <= runs[w][1] + 900_000_000:
            runs[w] = (runs[w][0], t, runs[w][2] + 1)
        else:
            want += [(w, *runs[w])] if w in runs else []
            runs[w] = (t, t, 1)
    want = [(w, first, last + 900_000_000, n) for w, first, last, n in want + [(w, *run) for w, run in runs.items()]]
    table = spark.createDataFrame(rows, "user_id long, ts timestamp")
    got = catalogue.played(spark, table, "user_id", lambda s: live.dropped(s, "user_id", "ts", "0 seconds"), per_file=20)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order) and len(want) > 100


def test_state_lies_in_as_many_partitions_as_there_are_cores(spark):
    """Whatever the session has for its shuffles, which stays as it was."""
    name, seen = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    table = spark.createDataFrame([(k % 7, at(60 * k)) for k in range(70)], "user_id long, ts timestamp")
    try:
        for given in ("500", "3"):
            spark.conf.set(name, given)
            got = catalogue.played(spark, table, "user_id", lambda s: seen.append(spark.conf.get(name)) or live.dropped(s, "user_id", "ts", "0 seconds"))
            assert sorted((r["user_id"], r["n"]) for r in got.collect()) == [(k, 10) for k in range(7)] and spark.conf.get(name) == given
    finally:
        spark.conf.set(name, before)
    assert seen == [str(max(8, spark.sparkContext.defaultParallelism)), "3"]


def test_the_end_of_a_source_comes_after_the_frame_of_its_time(spark, tmp_path):
    """Frames of 400 sources in one batch, the last one's mark of the end ahead of it: as `ledger.regions` has it, and no region of one frame beside it."""
    schema = "source int, at timestamp, p double"
    rows = [(s, at(s + k / 10), 0.9) for s in range(400) for k in range(20)]
    spark.createDataFrame([(399, at(400.9), None), *rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.speech_regions(stream, "source", "at", "p", "0 seconds", 0.1, least=0.0).writeStream.format("memory").queryName("marked").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = sorted(tuple(r) for r in spark.table("marked").collect())
    want = sorted(tuple(r) for r in ledger.regions(spark.createDataFrame(rows, schema), ["source"], "at", "p", 0.1, least=0.0).collect())
    closed = [r for r in want if r[2] <= MICRO + 400_600_000 or r[0] == 399]  # the others wait for silence
    assert got == closed and got[-1] == (399, MICRO + 399_000_000, MICRO + 401_000_000)

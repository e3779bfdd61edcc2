"""Streams: the consent ledger's current state, jobs, idle sessions, and protocol lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import consent


def states(stream: DataFrame) -> DataFrame:
    """The latest (seq, status) of each voice out of appended records (voice, seq, status), in update mode, with the status before it.

    `changed` tells a step from one status to another.  No watermark: a late revocation is never dropped.  A record older than
    the state changes nothing; of two with one seq the stricter one stands, whichever comes first (`consent.strictness`).
    """
    voice = stream.schema["voice"].dataType.simpleString()
    strict = lambda status: 2 if status == "revoked" else 0 if status in consent.USABLE else 1

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seq, status, previous = state.get if state.exists else (-1, "", "")
        begun = status
        for pdf in batches:
            for s, new in sorted(zip(pdf["seq"].tolist(), pdf["status"].tolist()), key=lambda r: (r[0], strict(r[1]))):
                if s > seq or s == seq and strict(new) > strict(status):
                    seq, status, previous = int(s), str(new), status
        state.update((seq, status, previous))
        yield pd.DataFrame({"voice": [key[0]], "seq": [seq], "status": [status], "previous": [previous], "changed": [status != begun]})

    schema = f"voice {voice}, seq long, status string, previous string, changed boolean"
    return stream.groupBy("voice").applyInPandasWithState(update, schema, "seq long, status string, previous string", "update", GroupStateTimeout.NoTimeout)


def regions(frames: DataFrame, keys: list[str], ts: str, probability: str, frame: float, threshold: float = 0.5, silence: float = 0.3, least: float = 0.25, most: float = 20.0, bucket: float = 3600.0) -> DataFrame:
    """keys, opened, closed (microseconds) of regions of speech in a table of frames; `live.speech_regions` does it for streams.

    A frame from `threshold` on is speech from its time until `frame` seconds later.  Speech that less than `silence` seconds part is one
    region; regions under `least` seconds are dropped, and those over `most` are cut at every multiple of it, by the clock.
    Frames without key, time or probability are none.

    Runs are found inside buckets of time and then joined over their borders, so no task holds all frames of a source.
    """
    micros = lambda x: round(x * 1e6)
    speech = frames.where((F.col(probability) >= threshold) & F.col(ts).isNotNull() & reduce(and_, (F.col(k).isNotNull() for k in keys)))
    runs = speech.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("opened")).withColumn("closed", F.col("opened") + micros(frame))

    def joined(x: DataFrame, within: list) -> DataFrame:
        w = W.partitionBy(*keys, *within).orderBy("opened", "closed")
        before = F.max("closed").over(w.rowsBetween(W.unboundedPreceding, -1))
        x = x.withColumn("__new", F.coalesce((F.col("opened") - before >= micros(silence)).cast("int"), F.lit(1)))
        x = x.withColumn("__run", F.sum("__new").over(w))
        return x.groupBy(*keys, *within, "__run").agg(F.min("opened").alias("opened"), F.max("closed").alias("closed"))

    runs = joined(runs.withColumn("__bucket", F.floor(F.col("opened") / micros(bucket))), ["__bucket"])
    runs = joined(runs.select(*keys, "opened", "closed"), []).where(F.col("closed") - F.col("opened") >= micros(least))
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil((F.col("closed") - F.col("opened")) / micros(most))) - 1)).alias("__part")
    begin = F.col("opened") + F.col("__part") * micros(most)
    return runs.select(*keys, "opened", "closed", parts).select(*keys, begin.alias("opened"), F.least("closed", begin + micros(most)).alias("closed"))


def jobs(records: DataFrame) -> DataFrame:
    """The state of each job out of records (job, seq, status, message), on streams (update mode) and tables: job, status, error, n.

    A job that is done or failed stays so, whatever comes late; otherwise the largest seq decides.
    """
    over = F.col("status").isin("done", "failed")
    last = F.max(F.struct(over.alias("over"), F.when(over, -F.col("seq")).otherwise(F.col("seq")).alias("seq"), "status", "message"))
    x = records.groupBy("job").agg(last.alias("s"), F.count(F.lit(1)).alias("n"))
    return x.select("job", "s.status", F.when(F.col("s.status") == "failed", F.col("s.message")).alias("error"), "n")


def sessions(events: DataFrame, keys: list[str], ts: str, idle: str, watermark: str | None = None) -> DataFrame:
    """keys, opened, closed, n: runs of events with no gap of `idle`; works on streams (with a watermark) and tables."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp"))
    x = x.withWatermark(ts, watermark) if watermark else x
    return x.groupBy(*keys, F.session_window(ts, idle).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "n")


def protocol(lines: DataFrame) -> DataFrame:
    """id, method, params (JSON), error: requests out of text lines; what is no request has an error, other lines have no id."""
    parsed = F.from_json("value", "id long, method string, params string")
    x = lines.withColumn("r", F.when(F.col("value").rlike(r"^\s*\{"), parsed))
    return x.select("value", "r.id", "r.method", "r.params", F.when(F.col("value").rlike(r"^\s*\{") & F.col("r.method").isNull(), F.lit("bad request")).alias("error"))


def until_shutdown(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The requests that a worker answers: those up to the first shutdown of its session, that one included."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ended = F.max(F.coalesce(F.col("method") == "shutdown", F.lit(False))).over(before)
    return requests.withColumn("__ended", F.coalesce(ended, F.lit(False))).where("NOT __ended").drop("__ended")


def answers(requests: DataFrame, handlers: dict[str, Callable[[dict], object]]) -> DataFrame:
    """Requests (id, method, params as JSON, error, ...) with `result` (JSON) and `error`: one of them is null.

    A method's handler gets the parameters (empty where there are none) and gives what becomes the result; what it raises becomes
    the error, and the next request is answered all the same.  `shutdown` says goodbye; methods without handler, lines that
    are no requests, and parameters that are no JSON object are errors.
    """
    names = [c for c in requests.columns if c not in ("result", "error")]

    def answer(method: str | None, params: str | None, broken: str | None) -> tuple[str | None, str | None]:
        if broken is not None:
            return None, broken
        if method == "shutdown":
            return json.dumps({"bye": True}), None
        if method not in handlers:
            return None, f"unknown method {method!r}"
        try:
            given = json.loads(params) if params else {}
            if not isinstance(given, dict):
                raise TypeError("parameters have to be an object")
            return json.dumps(handlers[method](given), ensure_ascii=False), None
        except Exception as problem:  # noqa: BLE001  reported to whoever asked
            return None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda c: c.astype(object).where(c.notna(), None)
        for pdf in batches:
            broken = plain(pdf["error"]) if "error" in pdf else [None] * len(pdf)
            said = [answer(*row) for row in zip(plain(pdf["method"]), plain(pdf["params"]), broken)]
            yield pdf[names].assign(result=[r for r, _ in said], error=[e for _, e in said])

    schema = T.StructType([*[requests.schema[c] for c in names], T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])
    return requests.mapInPandas(run, schema)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds (job, at, seq, message) to a log on disk; on streams, for use in foreachBatch."""
    rows.select("job", "at", "seq", "message").write.mode("append").parquet(path)


def log_tails(log: DataFrame, n: int = 6) -> DataFrame:
    """job, messages: the last n of each job, in the order of (at, seq); no task holds more of a job than that."""
    w = W.partitionBy("job").orderBy(F.desc("at"), F.desc("seq"))
    last = log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return last.groupBy("job").agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), "message"))).alias("m")).select("job", F.transform("m", lambda x: x["message"]).alias("messages"))

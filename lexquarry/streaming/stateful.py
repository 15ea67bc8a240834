"""Streams with state: job queue, retries, rate limits, expiring caches, and ingestion with deduplication.

Each operator has a batch twin over the same event log, so that a finished stream can be checked by replaying it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PRIORITY = {"critical": 0, "high": 1, "normal": 2, "low": 3}


def queue_order(jobs: DataFrame, priority: str, enqueued: str, tie: str, key: str | None = None) -> DataFrame:
    """Rank in which waiting jobs are taken: by priority, then first in, first out; within ``key`` if given."""
    p = F.lit(len(PRIORITY))
    for name, n in PRIORITY.items():
        p = F.when(F.col(priority) == name, F.lit(n)).otherwise(p)
    d = jobs.withColumn("__p", p)
    if key:
        return d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("__p", enqueued, tie))).drop("__p")
    # one queue for all: the rank within an hour of a priority, after all that the earlier hours and priorities hold
    d = d.withColumn("__h", F.date_trunc("hour", enqueued))
    sizes = d.groupBy("__p", "__h").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__b", F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__p", "__h")) - F.col("__c")).drop("__c")
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy("__p", "__h").orderBy(enqueued, tie)))
    return d.join(before, ["__p", "__h"]).withColumn("place", F.col("__b") + F.col("__r")).select(*jobs.columns, "place")


def job_state(events: DataFrame, job: str, status: str, ts: str, tie: str) -> DataFrame:
    """Latest status, number of attempts and first sight of each job, from its event log."""
    return events.groupBy(job).agg(F.max(F.struct(ts, tie, status))[status].alias("status"), F.count("*").alias("attempts"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def retry_delay(n: Column, kind: Column) -> Column:
    """Seconds to wait before the n-th retry by kind of failure."""
    return F.when(kind == "rate", 60 * n).when(kind == "network", F.least(5 * n, F.lit(30))).otherwise(F.least(F.pow(F.lit(2), n), F.lit(60))).cast("int")


def expired(ts: Column, as_of: Column, hours: int = 24) -> Column:
    return ts.cast("timestamp").cast("double") < as_of.cast("timestamp").cast("double") - 3600 * hours


def token_bucket(calls: int, period: float) -> Callable:
    """State function: each event takes a token; the bucket holds 1.5 times ``calls`` and fills ``calls`` a ``period``."""
    capacity, rate = int(calls * 1.5), calls / period

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ids, ok = [], []
        for ts, event in zip(rows["ts"], rows["event_id"]):
            now = ts.timestamp()
            if last is not None:
                tokens = min(float(capacity), tokens + max(0.0, now - last) * rate)
            last = now
            granted = tokens >= 1.0
            tokens -= 1.0 if granted else 0.0
            ids.append(int(event))
            ok.append(bool(granted))
        state.update((tokens, last))
        yield pd.DataFrame({"key": [key[0]] * len(ids), "event_id": ids, "granted": ok})

    return run


def limited(stream: DataFrame, key: str, calls: int, period: float) -> DataFrame:
    """``key, event_id, granted`` of a stream with ``ts`` and ``event_id``, one bucket for each key."""
    d = stream.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"))
    kind = dict(d.dtypes)["key"]
    return d.groupBy("key").applyInPandasWithState(token_bucket(calls, period), f"key {kind}, event_id bigint, granted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def _replay(calls: int, period: float, kind_of):
    step = token_bucket(calls, period)

    class Once:
        exists, get = False, None

        def update(self, value):
            self.get = value

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(step(key, iter([pdf]), Once())))

    return run


def limited_batch(df: DataFrame, key: str, calls: int, period: float) -> DataFrame:
    """The same decisions by replaying the whole log of each key."""
    d = df.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"))
    kind = dict(d.dtypes)["key"]
    return d.groupBy("key").applyInPandas(_replay(calls, period, kind), f"key {kind}, event_id bigint, granted boolean")


def windowed_counts(stream: DataFrame, ts: str, length: str, slide: str | None = None, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts for each tumbling or sliding window, with late rows up to ``late``."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    d = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return d.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    d = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return d.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def ingest(stream: DataFrame, text: str, ts: str, late: str = "1 day") -> DataFrame:
    """New documents once each: by content digest within the watermark on a stream, for good in a batch."""
    from ..functions.text import content_hash

    d = stream.withColumn("content_hash", content_hash(text))
    return d.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"]) if stream.isStreaming else d.dropDuplicates(["content_hash"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Takes all that is available into files and stops."""
    stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


class Steps:
    """A chain of named frame-to-frame steps with checks before and after, and the rows each step let through."""

    def __init__(self, *steps: tuple[str, Callable[[DataFrame], DataFrame]], check: Callable[[DataFrame], None] | None = None):
        self.steps, self.check, self.counts = steps, check, {}

    def run(self, df: DataFrame, measure: bool = False) -> DataFrame:
        for name, step in self.steps:
            if self.check:
                self.check(df)
            df = df.transform(step)
            if measure:
                self.counts[name] = df.count()
        return df

"""Stateful operators over streams of events, and their batch twins, which give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import folded

_DECISION = "key string, event_id long, allowed boolean, used long"


def _decide(rows: pd.DataFrame, start, used: int, limit: int, window: pd.Timedelta):
    """A window opens at the first event that is in none, whatever the clock's own minutes."""
    allowed, counts = [], []
    for t in rows["ts"]:
        if start is None or t >= start + window:
            start, used = t, 0
        used += 1
        allowed.append(used <= limit)
        counts.append(used)
    return rows.assign(allowed=allowed, used=counts)[["key", "event_id", "allowed", "used"]], start, used


def _timed(events: DataFrame) -> DataFrame:
    """An event without key or time is in no window."""
    return events.filter("key IS NOT NULL AND ts IS NOT NULL")


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """key, event_id, allowed, used for ``events`` (key, event_id, ts), by fixed windows of each key: a fold whose
    state is a window's start and what is used of it, however many events a key has. Events without key or time are
    left out."""

    def step(held: tuple, t: int) -> tuple[int, tuple]:
        start, used = held
        if start is None or t >= start + seconds * 1_000_000:
            start, used = t, 0
        return used + 1, (start, used + 1)

    # Microseconds are the same in any zone, and cost no object each.
    rows = _timed(events).select("key", "event_id", F.unix_micros("ts").alias("t"))
    used = folded(rows, "key", ["t", F.col("event_id").asc_nulls_last()], ["t"], lambda: (None, 0), step, "used", "int64")
    return used.select("key", "event_id", (F.col("used") <= limit).alias("allowed"), "used")


def rate_limited_stream(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """As rate_limited() for a stream that brings each key's events in order; a key's state is two numbers,
    and goes once its window is over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        start = pd.Timestamp(start) if start is not None else None
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        out, start, used = _decide(rows, start, used, limit, pd.Timedelta(seconds=seconds))
        state.update((start.isoformat(), used))
        state.setTimeoutTimestamp(int((start + pd.Timedelta(seconds=seconds)).timestamp() * 1000) + 1)
        yield out

    return _timed(events).withWatermark("ts", "0 seconds").groupBy("key").applyInPandasWithState(step, _DECISION, "start string, used long", "append", GroupStateTimeout.EventTimeTimeout)


def reserved(events: DataFrame, seconds: int) -> DataFrame:
    """key, event_id of events that reserve their key: those with no reservation of it in the ``seconds`` before."""
    return rate_limited(events, 1, seconds).filter("used = 1").select("key", "event_id")


def reserved_once(events: DataFrame, ttl: str) -> DataFrame:
    """First events of a key within ``ttl``, for a stream (id, key, ts)."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])


def expired_leases(jobs: DataFrame, now: str, most_attempts: int = 3) -> DataFrame:
    """status after a look at the clock: a running job whose lease is over is queued again, with a delay that
    doubles, or dead once it has had ``most_attempts``."""
    over = (F.col("status") == "running") & (F.col("lease_until") < F.lit(now).cast("timestamp"))
    delay = F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("long")
    status = F.when(over & (F.col("attempts") >= most_attempts), "dead").when(over, "queued").otherwise(F.col("status"))
    return jobs.withColumn("next_status", status).withColumn("delay", F.when(over & (F.col("attempts") < most_attempts), delay))


def admitted(queue: DataFrame, batch_limit: int, limit: int) -> DataFrame:
    """Jobs that may start: by priority and age, at most ``batch_limit`` of a batch and ``limit`` in all."""
    from pyspark.sql import Window

    order = [F.col("priority").desc(), F.col("created"), F.col("job_id")]
    own = queue.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(*order))).filter(F.col("place") <= batch_limit)
    return own.orderBy(*order).limit(limit).drop("place")


def read_since(log: DataFrame, stream: str, cursor: int, limit: int, kept: int = 1000) -> DataFrame:
    """Events of a stream after the cursor, of the last ``kept``."""
    newest = log.filter(F.col("stream") == stream).orderBy(F.col("seq").desc()).limit(kept)
    return newest.filter(F.col("seq") > cursor).orderBy("seq").limit(limit)


def compaction_ranges(events: DataFrame, key: str, order: str, least: int = 48, recent: int = 24) -> DataFrame:
    """key, upto: where a conversation of ``least`` events or more is summarised to, all but the last
    ``recent``."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last")).filter(F.col("n") >= least).select(key, (F.col("last") - recent).alias("upto"))


def run_to_end(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all input there is now, written as Parquet."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

"""Job events as streams: latest status, rate limit, completion barrier, quota.

Input events: key string, ts timestamp and what each function names. All state is bounded
by a watermark or by timers; batch DataFrames go through the stateless parts alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TERMINAL


def latest_status(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The latest event of each job (update mode): job_id, status, progress, ts."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    best = F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "progress"))
    return events.groupBy("job_id").agg(best.alias("x")).select("job_id", "x.*")


#: status: those it may be reached from (queued again: a retry)
TRANSITIONS = {"queued": ("processing",), "processing": ("queued",), "completed": ("processing",), "failed": ("queued", "processing"), "cancelled": ("queued", "processing")}


def rate_limited(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """client, ts, request_id, allowed: at most `limit` allowed requests in any trailing window of
    `seconds`; rejected ones do not count. Requests of a micro-batch are taken in order of time; a
    client's times are dropped when no request came for a window (event time).
    """
    window = seconds * 1000

    def decide(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        marks = []
        for now in (rows["ts"].astype("int64") // (1_000_000 if str(rows["ts"].dtype) == "datetime64[ns]" else 1000)).tolist():
            times = [t for t in times if t > now - window]
            marks.append(len(times) < limit)
            if marks[-1]:
                times.append(now)
        state.update((times,))
        ends = max([*times, state.getCurrentWatermarkMs()]) + window
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(client=key[0], allowed=marks)[["client", "ts", "request_id", "allowed"]]

    return requests.withWatermark("ts", f"{seconds} seconds").groupBy("client").applyInPandasWithState(
        decide, "client string, ts timestamp, request_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def completions(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Reconciliations both of whose jobs (bank and ledger) are terminal: rec_id, ok, ts (update mode).

    A sink keyed by rec_id makes completion idempotent: later updates carry the same values.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    done = F.col("status").isin(*TERMINAL)
    side = lambda s: F.max(F.when((F.col("side") == s) & done, F.col("status") == "completed"))
    g = events.groupBy("rec_id").agg(side("bank").alias("bank"), side("ledger").alias("ledger"), F.max(F.when(done, F.col("ts"))).alias("ts"))
    return g.where("bank is not null and ledger is not null").select("rec_id", (F.col("bank") & F.col("ledger")).alias("ok"), "ts")


def quota(usage: DataFrame) -> DataFrame:
    """Running pages per user (update mode)."""
    email = F.lower(F.trim("email"))
    return usage.where("pages > 0").groupBy(email.alias("email")).agg(F.sum("pages").alias("pages"))


def first_completions(done: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each rec_id once within the watermark."""
    return done.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["rec_id"])


def drop_oldest(events: DataFrame, capacity: int = 100) -> DataFrame:
    """What a bounded buffer still holds of each subscriber's events: the latest `capacity`."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("subscriber").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("place", rank).where(F.col("place") <= capacity).drop("place")


def cached(entries: DataFrame, now, ttl_seconds: int = 3600, capacity: int = 1000) -> DataFrame:
    """Cache entries alive at `now`: not older than the time to live, the latest used up to the capacity."""
    alive = entries.where(F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return alive.orderBy(F.desc("used_at"), "key").limit(capacity)

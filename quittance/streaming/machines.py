"""Stateful streams by key: the job state machine, the completion barrier with claims, bounded buffers, owned caches.

Each is a stateful processor whose state is what the next event needs and no more; timers in event time drop it.
Events of a micro-batch are taken in order of time and id. State lies in RocksDB beside the stream's checkpoint, so that a lost
executor's keys are restored elsewhere (`with_rocks` sets the provider; Python processors need it).

Cases: events without a key are not taken; repeated events are judged anew, as they come; an empty stream gives no rows; columns
that are not named are not read. Events older than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.jobs import TERMINAL
from .jobs import TRANSITIONS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def _in_order(rows, most: int = 10_000) -> Iterator:
    """The rows of a micro-batch and key by time and id.

    Up to `most` rows are sorted as they are. More are packed into Arrow columns as they come, and only `most` at a time are objects again.
    """
    rows = iter(rows)
    held = list(islice(rows, most))
    if len(held) < most:
        yield from sorted(held, key=lambda r: (r["at"], r["event_id"]))
        return
    import pyarrow as pa
    import pyarrow.compute as pc

    packed = {n: [] for n in held[0].asDict() if n != "ts"}
    while held:
        for n, parts in packed.items():
            parts.append(pa.array([r[n] for r in held]))
        held = list(islice(rows, most))
    columns = {}
    for n in list(packed):
        # parts without any value have no type of their own
        parts = packed.pop(n)
        kind = next((p.type for p in parts if not pa.types.is_null(p.type)), pa.null())
        columns[n] = pa.chunked_array([p.cast(kind) for p in parts], kind).combine_chunks()
    del parts
    table = pa.table(columns)
    order = pc.sort_indices(table.select(["at", "event_id"]), [("at", "ascending"), ("event_id", "ascending")])
    for start in range(0, len(order), most):
        yield from table.take(order.slice(start, most)).to_pylist()


def _columns_in_order(frames, types: dict[str, str], most: int = 50_000) -> Iterator[list[list]]:
    """What _in_order does, for a key's rows as pandas frames: lists of the named columns' values, `most` rows at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([(n, pa.type_for_alias(t)) for n, t in types.items()])
    packed = [pa.Table.from_pandas(f[list(types)], schema, preserve_index=False) for f in frames]
    if not packed:
        return
    table = pa.concat_tables(packed).combine_chunks()
    del packed
    order = pc.sort_indices(table.select(["at", "event_id"]), [("at", "ascending"), ("event_id", "ascending")])
    for start in range(0, len(order), most):
        yield [c.to_pylist() for c in table.take(order.slice(start, most)).columns]


#: times are microseconds since 1970 here: what a worker makes of timestamps depends on its zone
SECOND = 1_000_000


def _ms(at: int) -> int:
    """The timer's time at which all of the given microsecond has passed."""
    return -(-at // 1000)


def _keyed(events: DataFrame, key: str, columns: list[str], watermark: str, processor: StatefulProcessor, out: str, frames: bool = False) -> DataFrame:
    """frames: whether the processor takes and gives pandas frames; rows cost several times as much on their way to Python."""
    with_rocks(events.sparkSession)
    read = events.select(F.col(key).cast("string").alias(key), F.col("event_id").cast("bigint").alias("event_id"), "ts", F.unix_micros("ts").alias("at"), *columns)
    kept = read.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", watermark)
    grouped = kept.groupBy(key)
    made = (grouped.transformWithStateInPandas if frames else grouped.transformWithState)(processor, out.replace("ts timestamp", "ts bigint"), "Append", "EventTime")
    return made.withColumn("ts", F.timestamp_micros("ts")) if "ts" in made.columns else made


JOB_ROWS = "job_id string, event_id bigint, ts timestamp, status string, progress int, verdict string, delivered boolean"


class JobMachine(StatefulProcessor):
    """verdict: ok, unknown (no such job yet), illegal (no such transition), ended, late (before one already taken), timeout.

    A job begins by `queued`. Status follows TRANSITIONS; a status that is not final may be told again (progress). A
    subscriber is served from the first event to the first final one, `seconds` at most; delivered says whether the row
    reaches them. A job whose time is up and that has not ended gives a row `timeout`. `seconds` after its last
    opening or end the job is forgotten.
    """

    def __init__(self, seconds: int):
        self.limit = seconds * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, last bigint, opened bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        status, last, opened, told = self.state.get() or (None, None, None, False)
        for r in _in_order(rows):
            wanted = r["status"]
            if opened and not told and status not in TERMINAL and r["at"] > opened + self.limit:
                told = True  # the timer may come later than this event
                yield self._timeout(key, status, opened)
            if opened is None:
                verdict = "ok" if wanted == "queued" else "unknown"
            elif r["at"] < last:
                verdict = "late"
            elif status in TERMINAL:
                verdict = "ended"
            else:
                verdict = "ok" if wanted == status or status in TRANSITIONS.get(wanted, ()) else "illegal"
            if opened is None and verdict == "ok":
                opened = r["at"]
                self.handle.registerTimer(_ms(opened + self.limit))
            delivered = verdict == "ok" and r["at"] <= opened + self.limit
            if verdict == "ok":
                status, last = wanted, r["at"]
            yield Row(job_id=key[0], event_id=r["event_id"], ts=r["at"], status=status, progress=r["progress"], verdict=verdict, delivered=delivered)
        if opened is not None:
            self.state.update((status, last, opened, told))

    def _timeout(self, key, status, opened) -> Row:
        return Row(job_id=key[0], event_id=None, ts=opened + self.limit, status=status, progress=None, verdict="timeout", delivered=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if (state := self.state.get()) is None:
            return
        status, last, opened, told = state
        if status not in TERMINAL and not told:
            told = True
            yield self._timeout(key, status, opened)
        until = _ms(last + self.limit)
        if until > expiredTimerInfo.getExpiryTimeInMs():  # it was heard of since
            self.state.update((status, last, opened, told))
            self.handle.registerTimer(until)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def job_states(events: DataFrame, seconds: int = 1800, watermark: str = "10 minutes") -> DataFrame:
    """A row (JOB_ROWS) for each event, and for each timeout. events: job_id, event_id, ts, status, progress."""
    return _keyed(events, "job_id", ["status", F.col("progress").cast("int").alias("progress")], watermark, JobMachine(seconds), JOB_ROWS)


CLAIM_ROWS = "rec_id string, event_id bigint, ts timestamp, kind string, worker string, verdict string"


class Barrier(StatefulProcessor):
    """Events bank and ledger (a side's job has ended), claim, done, fail; verdicts:

    waiting and ready (once, with the second side), repeated; granted, early (a side is missing), held (claimed less than
    or exactly `seconds` ago), over; completed (once), failed. A claim that ends in nothing gives a row `expired` when its time is up,
    after which the next claim is granted. State goes a day after the last event.
    """

    def __init__(self, seconds: int, keep: int = 86_400):
        self.hold, self.keep = seconds * SECOND, keep * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("barrier", "bank boolean, ledger boolean, status string, claimed bigint, worker string, told boolean, last bigint")

    def handleInputRows(self, key, rows, timerValues):
        bank, ledger, status, claimed, worker, told, last = self.state.get() or (False, False, "processing", None, None, False, None)
        for r in _in_order(rows):
            kind, ts = r["kind"], r["at"]
            if claimed and not told and status == "processing" and ts > claimed + self.hold:
                told = True
                yield self._expired(key, claimed, worker)
            if kind in ("bank", "ledger"):
                again, before = (bank if kind == "bank" else ledger), bank and ledger
                bank, ledger = bank or kind == "bank", ledger or kind == "ledger"
                verdict = "repeated" if again else "ready" if bank and ledger and not before else "waiting"
            elif kind == "claim":
                verdict = "over" if status != "processing" else "early" if not (bank and ledger) else "held" if claimed and claimed >= ts - self.hold else "granted"
                if verdict == "granted":
                    claimed, worker, told = ts, r["worker"], False
                    self.handle.registerTimer(_ms(ts + self.hold) + 1)
            elif kind == "done":
                verdict = "over" if status == "completed" else "completed"
                status = "completed"
            elif kind == "fail":
                verdict = "over" if status != "processing" else "failed"
                status = status if verdict == "over" else "failed"
            else:
                verdict = "unknown"
            last = max(last or ts, ts)
            yield Row(rec_id=key[0], event_id=r["event_id"], ts=ts, kind=kind, worker=r["worker"], verdict=verdict)
        self.state.update((bank, ledger, status, claimed, worker, told, last))
        self.handle.registerTimer(_ms(last + self.keep))

    def _expired(self, key, claimed, worker) -> Row:
        return Row(rec_id=key[0], event_id=None, ts=claimed + self.hold, kind="claim", worker=worker, verdict="expired")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if (state := self.state.get()) is None:
            return
        bank, ledger, status, claimed, worker, told, last = state
        at = expiredTimerInfo.getExpiryTimeInMs()
        if claimed and not told and status == "processing" and at > _ms(claimed + self.hold):
            yield self._expired(key, claimed, worker)
            self.state.update((bank, ledger, status, claimed, worker, True, last))
        if at >= _ms(last + self.keep):
            self.state.clear()

    def close(self) -> None:
        pass


def barrier(events: DataFrame, seconds: int = 600, watermark: str = "10 minutes") -> DataFrame:
    """A row (CLAIM_ROWS) for each event and for each claim that ran out. events: rec_id, event_id, ts, kind, worker."""
    return _keyed(events, "rec_id", ["kind", F.col("worker").cast("string").alias("worker")], watermark, Barrier(seconds), CLAIM_ROWS)


BUFFER_ROWS = "subscriber string, event_id bigint, ts timestamp, taken bigint, waiting int, dropped bigint"


class Buffer(StatefulProcessor):
    """A queue of `capacity` messages, as list state: publishing into a full one drops the oldest; taking gives the oldest."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "message bigint")
        self.lost = handle.getValueState("lost", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        lost = (self.lost.get() or (0,))[0]
        for r in _in_order(rows):
            if r["take"]:
                taken = held.pop(0) if held else None
                yield Row(subscriber=key[0], event_id=r["event_id"], ts=r["at"], taken=taken, waiting=len(held), dropped=lost)
                continue
            if len(held) >= self.capacity:
                held.pop(0)
                lost += 1
            held.append(r["event_id"])
        self.messages.put([(m,) for m in held]) if held else self.messages.clear()
        self.lost.update((lost,))

    def close(self) -> None:
        pass


def buffered(events: DataFrame, capacity: int = 100, watermark: str = "10 minutes") -> DataFrame:
    """A row (BUFFER_ROWS) for each event with `take`, which gets the oldest message (its event_id) or none; others publish."""
    return _keyed(events, "subscriber", [F.coalesce("take", F.lit(False)).alias("take")], watermark, Buffer(capacity), BUFFER_ROWS)


CACHE_ROWS = "cache string, event_id bigint, op string, key string, found string, size int"


class Cache(StatefulProcessor):
    """Entries by key with an end of life and an owner, as map state; full, the one unused for longest goes.

    set drops what has expired, then the least used entry if full, then stores; get gives the value of a living entry to its owner (or where either is
    unnamed) and counts as use; delete is the owner's. Entries live up to and including their last moment.
    """

    def __init__(self, seconds: int, capacity: int):
        self.life, self.capacity = seconds * SECOND, capacity

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "until bigint, owner string, value string, used bigint")

    def handleInputRows(self, key, rows, timerValues):
        stored = {k[0]: tuple(v) for k, v in self.entries.iterator()} if self.entries.exists() else {}
        held = OrderedDict(sorted(((k, v[:3]) for k, v in stored.items()), key=lambda e: stored[e[0]][3]))
        never = 1 << 62
        first = min((v[0] for v in held.values()), default=never)  # no entry ends before
        for columns in _columns_in_order(rows, {"event_id": "int64", "at": "int64", "op": "string", "key": "string", "owner": "string", "value": "string"}):
            told = []
            for event_id, now, op, name, asks, given in zip(*columns):
                until, owner, value = held.get(name, (None, None, None))
                mine, found = not owner or not asks or owner == asks, None
                if op == "set" and name:
                    if now > first:
                        for k in [k for k, v in held.items() if now > v[0]]:
                            del held[k]
                        first = min((v[0] for v in held.values()), default=never)
                    if len(held) >= self.capacity:
                        held.popitem(last=False)
                    held[name] = (now + self.life, asks, given)
                    held.move_to_end(name)
                    first = min(first, now + self.life)
                elif until is not None and op == "get":
                    if now > until:
                        del held[name]
                    elif mine:
                        held.move_to_end(name)
                        found = value
                elif until is not None and op == "delete" and mine:
                    del held[name]
                if op != "set":
                    told.append((key[0], event_id, op, name, found, len(held)))
            if told:
                yield pd.DataFrame(told, columns=[c.split()[0] for c in CACHE_ROWS.split(", ")])
        for k in stored.keys() - held.keys():
            self.entries.removeKey((k,))
        for place, (k, v) in enumerate(held.items()):
            if stored.get(k) != (*v, place):
                self.entries.updateValue((k,), (*v, place))

    def close(self) -> None:
        pass


def cached_values(operations: DataFrame, seconds: int = 3600, capacity: int = 1000, watermark: str = "10 minutes") -> DataFrame:
    """A row (CACHE_ROWS) for each get and delete. operations: cache, event_id, ts, op (set, get, delete), key, owner, value."""
    return _keyed(operations, "cache", ["op", "key", "owner", "value"], watermark, Cache(seconds, capacity), CACHE_ROWS, frames=True)

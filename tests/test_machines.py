"""Stateful streams over several micro-batches against plain loops; illegal, late, silent, replayed and lost events."""

import os
import random
from collections import OrderedDict, defaultdict
from datetime import datetime, timedelta

from quittance.plans.queries_streams import _finished
from quittance.streaming import events, machines

RANDOM = random.Random(11)
START = datetime(2026, 1, 1)
FINAL = {"completed", "failed", "cancelled"}
FROM = {"queued": {"processing"}, "processing": {"queued"}, "completed": {"processing"}, "failed": {"queued", "processing"}, "cancelled": {"queued", "processing"}}


def at(seconds):
    return START + timedelta(seconds=seconds)


def streamed(spark, folder, ddl, batches):
    """A stream that reads each batch by itself, in order."""
    os.makedirs(folder)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/in-{k}")
        for f in os.listdir(f"{folder}/in-{k}"):
            if f.endswith(".parquet"):
                os.rename(f"{folder}/in-{k}/{f}", f"{folder}/{k:04d}.parquet")
                os.utime(f"{folder}/{k:04d}.parquet", (1000 + k, 1000 + k))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "0*.parquet").parquet(str(folder))


def cut(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


JOBS = "job_id string, event_id bigint, ts timestamp, status string, progress int, extra string"


def job_loop(rows, seconds, heard_until):
    out, jobs = [], {}
    for job, event, ts, status, progress, _ in rows:
        if job is None:
            continue
        j = jobs.setdefault(job, {"status": None, "opened": None, "last": None, "told": False})
        if j["opened"] and not j["told"] and j["status"] not in FINAL and ts > j["opened"] + timedelta(seconds=seconds):
            j["told"] = True
            out.append((job, None, j["opened"] + timedelta(seconds=seconds), j["status"], None, "timeout", True))
        if j["opened"] is None:
            verdict = "ok" if status == "queued" else "unknown"
            j["opened"] = ts if verdict == "ok" else None
        elif ts < j["last"]:
            verdict = "late"
        elif j["status"] in FINAL:
            verdict = "ended"
        else:
            verdict = "ok" if status == j["status"] or j["status"] in FROM.get(status, ()) else "illegal"
        if verdict == "ok":
            j["status"], j["last"] = status, ts
        out.append((job, event, ts, j["status"], progress, verdict, verdict == "ok" and ts <= j["opened"] + timedelta(seconds=seconds)))
    for job, j in jobs.items():
        if j["opened"] and not j["told"] and j["status"] not in FINAL and j["opened"] + timedelta(seconds=seconds) <= heard_until:
            out.append((job, None, j["opened"] + timedelta(seconds=seconds), j["status"], None, "timeout", True))
    return out


def test_jobs(spark, tmp_path):
    rows, now = [], 0
    for k in range(160):
        now += RANDOM.randrange(1, 40)
        rows.append((RANDOM.choice(["a", "b", "c", "d", None]), k, at(now), RANDOM.choice(["queued", "processing", "processing", "completed", "failed", "cancelled", "other"] if k > 12 else ["queued", "processing"]), k % 100, "x"))
    rows += [("silent", 500, at(now), "queued", 0, "x"), ("slow", 501, at(now), "queued", 0, "x"), ("slow", 502, at(now + 500), "processing", 1, "x"), ("slow", 503, at(now + 400), "completed", 2, "x"), ("slow", 504, at(now + 1900), "completed", 3, "x"), ("z", 505, at(now + 4000), "processing", 0, "x")]
    df = streamed(spark, tmp_path / "jobs", JOBS, cut(rows[:160], 40) + cut(rows[160:163], 3) + cut(rows[163:], 1))
    got = [tuple(r) for r in _finished(machines.job_states(df), "append", "jobs").collect()]
    want = job_loop(rows, 1800, rows[-1][2] - timedelta(minutes=10))
    assert sorted(got, key=str) == sorted(want, key=str)
    verdicts = {r[5] for r in got}
    assert verdicts == {"ok", "unknown", "illegal", "ended", "late", "timeout"}
    assert [r[0] for r in got if r[5] == "timeout" and r[0] in ("silent", "slow")].count("silent") == 1


CLAIMS = "rec_id string, event_id bigint, ts timestamp, kind string, worker string"


def test_claims(spark, tmp_path):
    script = [
        ("r", 0, "bank", None), ("r", 1, "claim", "w1"), ("r", 2, "bank", None), ("r", 3, "ledger", None), ("r", 10, "claim", "w1"), ("r", 10, "claim", "w2"), ("r", 609, "claim", "w3"),
        ("r", 611, "claim", "w4"), ("r", 700, "done", "w4"), ("r", 701, "done", "w4"), ("r", 702, "claim", "w5"), ("r", 703, "fail", "w4"),
        ("s", 705, "bank", None), ("s", 706, "ledger", None), ("s", 710, "claim", "w1"), ("t", 711, "bank", None), ("t", 712, "ledger", None), ("t", 713, "claim", "w"), ("t", 714, "fail", "w"), ("t", 715, "claim", "w"), ("t", 716, "odd", "w"), ("u", 5000, "bank", None),
    ]
    rows = [(rec, k, at(s), kind, w) for k, (rec, s, kind, w) in enumerate(script)]
    for size in (1, 5, 100):
        df = streamed(spark, tmp_path / f"claims{size}", CLAIMS, cut(rows, size))
        got = {(r["rec_id"], r["event_id"], r["verdict"]) for r in _finished(machines.barrier(df), "append", "claims").collect()}
        want = ["waiting", "early", "repeated", "ready", "granted", "held", "held", "granted", "completed", "over", "over", "over", "waiting", "ready", "granted", "waiting", "ready", "granted", "failed", "over", "unknown", "waiting"]
        assert {(r, e, v) for r, e, v in got if e is not None} == {(script[k][0], k, v) for k, v in enumerate(want)}
        assert {(r, v) for r, e, v in got if e is None} == {("r", "expired"), ("s", "expired")}  # lost claims; s's is told by the clock


def test_burst_into_a_buffer(spark, tmp_path):
    rows = [("s", k, at(k), False) for k in range(150)] + [("s", 150 + k, at(150 + k), True) for k in range(102)] + [(None, 900, at(300), True), ("t", 901, at(301), True), ("t", 902, at(302), None)]
    df = streamed(spark, tmp_path / "buffer", "subscriber string, event_id bigint, ts timestamp, take boolean", cut(rows, 60))
    got = sorted((r["subscriber"], r["event_id"], r["taken"], r["waiting"], r["dropped"]) for r in _finished(machines.buffered(df), "append", "buffer").collect() if r["subscriber"] == "s" and r["taken"] is not None)
    assert got == [("s", 150 + k, 50 + k, 99 - k, 50) for k in range(100)]


def test_cache(spark, tmp_path):
    rows = []
    for k in range(240):
        op = RANDOM.choice(["set", "set", "get", "get", "delete"])
        rows.append((RANDOM.choice(["a", "b"]), k, at(40 * k), op, RANDOM.choice(["k1", "k2", "k3", "k4", "k5", "k6", ""]), RANDOM.choice([None, "x", "y"]), f"v{k}"))
    ddl = "cache string, event_id bigint, ts timestamp, op string, key string, owner string, value string"
    df = streamed(spark, tmp_path / "cache", ddl, cut(rows, 37))
    got = sorted((r["cache"], r["event_id"], r["found"], r["size"]) for r in _finished(machines.cached_values(df, 900, 4), "append", "cache").collect())
    want, caches = [], defaultdict(OrderedDict)
    for cache, k, ts, op, key, owner, value in rows:
        held, found = caches[cache], None
        if op == "set":
            if key:
                for x in [x for x, e in held.items() if e[0] < ts]:
                    held.pop(x)
                if len(held) == 4:
                    held.popitem(last=False)
                held.pop(key, None)
                held[key] = (ts + timedelta(seconds=900), owner, value)
            continue
        if key in held:
            until, of, stored = held[key]
            mine = None in (of, owner) or of == owner
            if op == "delete":
                if mine:
                    held.pop(key)
            elif ts > until:
                held.pop(key)
            elif mine:
                held.move_to_end(key)
                found = stored
        want.append((cache, k, found, len(held)))
    assert got == sorted(want) and sum(w[2] is not None for w in want) > 20


def event(job, k, ts, name="progress"):
    return (job, k, at(ts), f"ocr.job.{name}", name, "ocr", k, 9, k * 10, f"Completed Part {k} of 9")


def test_events_are_published_once(spark, tmp_path):
    """A batch that runs again changes nothing; one that failed half way is written anew; readers of one job and of all get each event once."""
    folder, publish = f"file://{tmp_path}/bus", events.publisher(f"file://{tmp_path}/bus")
    frame = lambda rows: spark.createDataFrame(rows, events.EVENTS)
    first = frame([event("a", 1, 5), event("a", 1, 5), event("b", 2, 6), event(None, 3, 7)])
    second = frame([event("a", 4, 9, "completed"), event("a", 3, 8), event("c", 5, 9)])
    publish(first, 0)
    spark.createDataFrame([], events.EVENTS).write.parquet(f"{folder}/jobs/batch=7/_temporary/x")  # an attempt that was never committed
    publish(first, 0)
    publish(second, 1)
    publish(second, 1)
    publish(frame([]), 2)
    table = {r["job_id"]: (r["status"], r["processed_pages"]) for r in events.jobs(spark, folder).collect()}
    assert table == {"a": ("completed", 4), "b": ("progress", 2), "c": ("progress", 5)}
    got = [(r["job_id"], r["event_id"]) for r in _finished(events.subscribe(spark, folder), "append", "all").collect()]
    assert sorted(got) == [("a", 1), ("a", 3), ("a", 4), ("b", 2), ("c", 5)]
    mine = _finished(events.subscribe(spark, folder, "a").select("event_id", events.frame().alias("frame")), "append", "one").orderBy("event_id").collect()
    assert [r["event_id"] for r in mine] == [1, 3, 4] and mine[2]["frame"].startswith('event: ocr.job.completed\ndata: {"job_id":"a","event":"ocr.job.completed"') and mine[2]["frame"].endswith("\n\n")


def test_restart_after_lost_commit(spark, tmp_path):
    """The last batch's commit is lost, the stream starts again: table and events are as before. The listener hears of it."""
    heard = events.Progress()
    spark.streams.addListener(heard)
    batches = cut([event("ab"[k % 2], k, k) for k in range(9)], 3)
    df = streamed(spark, tmp_path / "in", events.EVENTS, batches)
    folder = f"{tmp_path}/bus"

    def run():
        df.writeStream.foreachBatch(events.publisher(f"file://{folder}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    before = sorted(map(tuple, spark.read.parquet(f"file://{folder}/events").collect()))
    for name in os.listdir(f"{folder}/state/commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(f"{folder}/state/commits/{name}")
    run()
    assert sorted(map(tuple, spark.read.parquet(f"file://{folder}/events").collect())) == before and len(before) == 9
    spark.streams.removeListener(heard)
    assert sum(rows for _, _, rows, _ in heard.batches) >= 9 and None in heard.ended.values()


def test_rows_of_a_large_key_are_packed():
    import tracemalloc

    from pyspark.sql import Row

    n = 60_000
    places = random.Random(5).sample(range(n), n)
    rows = lambda: (Row(cache="a", event_id=k, ts=START, at=k // 3, op="get", key=str(k % 30), owner=None if k < n - 9 else "o", value=f"v{k}") for k in places)
    tracemalloc.start()
    got = 0
    for k, r in enumerate(machines._in_order(rows(), 1000)):
        assert (r["event_id"], r["at"], r["value"], r["owner"]) == (k, k // 3, f"v{k}", None if k < n - 9 else "o")
        got += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and peak < 100 * n


def test_a_cache_reads_and_gives_whole_frames():
    """A key's rows come as frames in any order and go as frames: no row object a row, and no look at all entries for each set."""
    import pandas as pd

    class State:
        kept = {}
        exists = lambda self: bool(self.kept)
        iterator = lambda self: iter(self.kept.items())
        updateValue = lambda self, k, v: self.kept.__setitem__(k, v)
        removeKey = lambda self, k: self.kept.pop(k)

    n = 30_000
    places = random.Random(6).sample(range(n), n)
    ops = pd.DataFrame({"event_id": places, "at": [k * machines.SECOND for k in places], "op": [("set", "get", "get")[k % 3] for k in places], "key": [str(k // 3 % 30) for k in places], "owner": None, "value": [f"v{k}" for k in places]})
    cache = machines.Cache(3600, 40)
    cache.entries = State()
    got = pd.concat(list(cache.handleInputRows(("a",), iter([ops[:7000], ops[7000:]]), None)))
    assert len(got) == 2 * n // 3 and list(got["event_id"]) == [k for k in range(n) if k % 3]
    assert list(got["found"]) == [f"v{k - k % 3}" for k in got["event_id"]] and got["size"].max() == 30 == len(State.kept)

"""Progress events: a stream that keeps a table of jobs and publishes each event once, readers of one job or of all, and a listener.

Each micro-batch writes two folders named by its number: the latest state of the jobs it touched, and its events. A
batch that is run again after a failure finds its folders written and leaves them, so both are exact whatever restarts
happen; a folder of a failed attempt is written anew. Readers stream the events' folder.

Cases: events without a job are not taken; of a job's events with one time the greater event_id is the later; repeated
events (one job and event_id) within a batch are one; an empty batch writes empty folders; texts go as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENTS = "job_id string, event_id bigint, ts timestamp, event string, status string, stage string, processed_pages int, total_pages int, progress int, message string"
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
#: what ends a job's events (fixed values)
FINAL = ("ocr.job.completed", "ocr.job.failed", "ocr.job.cancelled")


def _written(spark: SparkSession, folder: str) -> bool:
    """Whether a writer has committed this folder; files show only when a write is done."""
    try:
        spark.read.parquet(folder)
        return True
    except AnalysisException:
        return False


def publisher(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's job states under folder/jobs, then its events under folder/events."""

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.where("job_id is not null").select(*_NAMES).dropDuplicates(["job_id", "event_id"])
        latest = F.max_by(F.struct(*_NAMES[1:]), F.struct("ts", "event_id"))
        parts = {"jobs": lambda: kept.groupBy("job_id").agg(latest.alias("x")).select("job_id", "x.*"), "events": lambda: kept}
        for name, rows in parts.items():
            path = f"{folder}/{name}/batch={number}"
            if not _written(spark, path):
                rows().write.mode("overwrite").parquet(path)

    return publish


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The table of jobs: the latest state of each (EVENTS)."""
    states = spark.read.schema(EVENTS + ", batch bigint").parquet(f"{folder}/jobs")
    latest = F.max_by(F.struct(*_NAMES[1:]), F.struct("ts", "event_id"))
    return states.groupBy("job_id").agg(latest.alias("x")).select("job_id", "x.*")


def subscribe(spark: SparkSession, folder: str, job_id: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """A stream of the events of a job, or of all: each once."""
    events = spark.readStream.schema(EVENTS + ", batch bigint").parquet(f"{folder}/events").drop("batch")
    mine = events if job_id is None else events.where(F.col("job_id") == job_id)
    return mine.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job_id", "event_id"])


def frame() -> Column:
    """An event as a server-sent one: its name, its fields as JSON, an empty line."""
    data = F.to_json(F.struct(*[F.col(c) for c in _NAMES if c not in ("event_id", "ts")], F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")))
    return F.concat(F.lit("event: "), "event", F.lit("\ndata: "), data, F.lit("\n\n"))


class Progress(StreamingQueryListener):
    """Keeps number, input rows and duration of the last `most` batches of every query, and how queries ended."""

    def __init__(self, most: int = 1000):
        self.most, self.batches, self.ended = most, [], {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.numInputRows, p.batchDuration))
        del self.batches[: -self.most]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

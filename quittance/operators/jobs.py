"""Operational queries over jobs and documents: statistics, searches, pages, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import prefix

TERMINAL = ("completed", "failed", "cancelled")
STATUSES = ("queued", "processing", *TERMINAL)


def stats(jobs: DataFrame) -> DataFrame:
    """Counts by status, pages, mean time of completed jobs and retries, in one pass."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    done = F.col("status") == "completed"
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        *[of(s) for s in STATUSES],
        F.sum(F.when(done, F.col("pages")).otherwise(0)).alias("pages_done"),
        F.round(F.avg(F.when(done, F.col("processing_ms"))), 2).alias("mean_ms"),
        F.sum("retries").alias("retries"),
    )


def by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("pages").alias("pages"), F.sum("retries").alias("retries"))


def latest(rows: DataFrame, when: str, ties: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(when), F.desc(ties)).limit(k)


def listed(rows: DataFrame, owner: str | None = None, kind: str = "all", status: str = "all") -> DataFrame:
    """Rows of an owner (all if None), of a document type and status unless these are "all"."""
    keep = F.lit(True)
    for column, value in (("owner", owner), ("document_type", None if kind == "all" else kind), ("status", None if status == "all" else status)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    return rows.where(keep)


def contains(columns: list[str], term: str) -> Column:
    """Case-insensitive literal search in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
    return found


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The page `number` from 1, sorted; the sort ends at its last row (offset and limit)."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(rows: DataFrame, size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint").alias("pages"))


def sections_page(sections: list[tuple[int, DataFrame]], first: int, size: int) -> DataFrame:
    """Rows [first, first + size) of report sections laid end to end. Sections: number, DataFrame(row_no, item).

    The sections' counts (a number each) say which of them the page touches; only those are sorted, in ranges, and
    numbered, and only the page's rows come back.
    """
    union = None
    for number, df in sections:
        part = df.select(F.lit(number).alias("section"), "row_no", "item")
        union = part if union is None else union.unionByName(part)
    counts = {r["section"]: r["n"] for r in union.groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, wanted = 0, F.lit(False)
    touched = []
    for number in sorted(counts):
        low, high = max(first - start, 0), min(first + size - start, counts[number])
        if low < high:
            touched.append(number)
            wanted = wanted | ((F.col("section") == number) & F.col("place").between(low + 1, high))
        start += counts[number]
    if not touched:
        return union.limit(0)
    placed = prefix.running(union.where(F.col("section").isin(touched)), ["section"], ["row_no", "item"], {"place": F.lit(1)})
    return placed.where(wanted).drop("place").orderBy("section", "row_no", "item")


def stale(jobs: DataFrame, now: Column, seconds: int = 600, max_retries: int = 3) -> DataFrame:
    """Processing jobs not updated for `seconds`: requeued up to max_retries, then failed."""
    late = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.where(late).select("job_id", "retries", F.when(F.col("retries") < max_retries, "requeue").otherwise("fail").alias("action"))


def upserted(old: DataFrame, new: DataFrame, key: str, when: str) -> DataFrame:
    """The latest row for each key of both tables, with the time of the first as created_at.

    Of rows with one time, one of `new` stands over those of `old`, and else the greater by all columns, so that
    the result does not depend on how rows are dealt. A key that `old` has keeps its time there, the earliest if it has several.
    """
    marked = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = F.struct(when, "__new", *[c for c in old.columns if c not in (key, when)])
    of_old = F.min(F.when(F.col("__new") == 0, F.col(when)))
    best = marked.groupBy(key).agg(F.max(order).alias("__row"), F.coalesce(of_old, F.min(when)).alias("created_at"))
    return best.select(*[F.col(c) if c == key else F.col("__row")[c].alias(c) for c in old.columns], "created_at")


def quota(usage: DataFrame) -> DataFrame:
    """Pages per user; guests, empty addresses and counts of 0 or less do not count."""
    email = F.lower(F.trim("email"))
    return usage.select(email.alias("email"), "pages").where("pages > 0 and email is not null and email not in ('', 'guest', 'none', 'null')").groupBy("email").agg(F.sum("pages").alias("pages"))


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first table, and those of the second whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))

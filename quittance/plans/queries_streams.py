"""Queries of exports and of streams run to their end over the events table, with SQL where stateless."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import exports
from ..streaming import events, jobs as stream, machines
from . import driver_data as data
from .queries_documents import _CASE_STATUS, _STATUS
from .queries_recon import _CATEGORY, _STATEMENTS, _statements


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; on one machine in a temporary one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stream-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _finished(df: DataFrame, mode: str, name: str) -> DataFrame:
    """A stream over all files at hand, run to its end into a table in memory, or for append mode into Parquet."""
    spark = df.sparkSession
    folder = _folder(spark, name)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/rows")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def _events(spark, sf):
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    # a stream reads folders; a table of one file is picked from its folder
    one = [f for f in batch.inputFiles() if f.endswith("/events.parquet")]
    found = reader.option("pathGlobFilter", "events.parquet").parquet(sf) if one else reader.parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def _statuses(spark, sf):
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv]), F.col("event_type"))
    return _events(spark, sf).select((F.col("user_id") % 50).alias("job_id"), status.alias("status"), F.col("event_id").alias("progress"), "ts", (F.col("user_id") % 20).alias("rec_id"), F.when(F.col("event_id") % 2 == 0, "bank").otherwise("ledger").alias("side"))


def stream_job_latest(spark: SparkSession, sf: str) -> DataFrame:
    latest = stream.latest_status(_statuses(spark, sf).drop("rec_id", "side"))
    return _finished(latest, "complete", "latest").select("job_id", "status", "progress")


def stream_completion(spark: SparkSession, sf: str) -> DataFrame:
    return _finished(stream.completions(_statuses(spark, sf)), "complete", "completion").select("rec_id", "ok")


def stream_quota(spark: SparkSession, sf: str) -> DataFrame:
    usage = _events(spark, sf).select(F.concat(F.lit("User"), (F.col("user_id") % 20).cast("string")).alias("email"), (F.col("event_id") % 12 - 2).alias("pages"))
    return _finished(stream.quota(usage), "complete", "quota")


def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of few clients under a limit of five in ten minutes."""
    requests = _events(spark, sf).select((F.col("user_id") % 5).cast("string").alias("client"), "ts", F.col("event_id").alias("request_id"))
    return _finished(stream.rate_limited(requests, 5, 600), "append", "limit").select("client", "request_id", "allowed")


def buffer_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = data.load(spark, sf, "events").select((F.col("user_id") % 7).alias("subscriber"), "ts", "event_id")
    return stream.drop_oldest(e, 100).groupBy("subscriber").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The table of jobs and what a reader of all events has got, after both streams have run to their end."""
    e = _statuses(spark, sf).withColumn("total_pages", F.lit(12)).withColumn("processed_pages", (F.col("progress") % 12 + 1).cast("int"))
    e = e.select(
        F.col("job_id").cast("string").alias("job_id"), F.col("progress").alias("event_id"), "ts", F.concat(F.lit("ocr.job."), "status").alias("event"), "status", F.lit("ocr").alias("stage"), "processed_pages", "total_pages",
        F.floor(F.col("processed_pages") * 100 / F.col("total_pages")).cast("int").alias("progress"), F.format_string("Completed Part %d of %d", "processed_pages", "total_pages").alias("message"),
    )
    folder = _folder(spark, "progress")
    e.writeStream.foreachBatch(events.publisher(folder)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    got = _finished(events.subscribe(spark, folder), "append", "reader").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("event_id").alias("ids"))
    return events.jobs(spark, folder).join(got, "job_id").select("job_id", "status", "progress", "message", "n_events", "ids")


def stream_job_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Eight events after another are a job's."""
    e = _statuses(spark, sf).withColumns({"job_id": F.floor(F.col("progress") / 8).cast("string"), "event_id": F.col("progress")})
    return _finished(machines.job_states(e), "append", "machine").select("job_id", "event_id", "status", "verdict", "delivered")


_KIND = {"view": "bank", "click": "ledger", "purchase": "claim", "error": "done", "signup": "fail"}
_KINDS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items()) + " END"


def stream_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve events after another are a reconciliation's."""
    e = _events(spark, sf).select(F.floor(F.col("event_id") / 12).cast("string").alias("rec_id"), "event_id", "ts", F.expr(_KINDS).alias("kind"), (F.col("user_id") % 3).alias("worker"))
    return _finished(machines.barrier(e), "append", "claims").select("rec_id", "event_id", "kind", "worker", "verdict")


def stream_buffers(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases take a message, all else publishes one; few subscribers, so that buffers overflow."""
    e = _events(spark, sf).select((F.col("user_id") % 7).alias("subscriber"), "event_id", "ts", (F.col("event_type") == "purchase").alias("take"))
    return _finished(machines.buffered(e), "append", "buffers").select("subscriber", "event_id", "taken", "waiting", "dropped")


_OP = "CASE WHEN event_type IN ('view', 'click') THEN 'set' WHEN event_type = 'signup' THEN 'delete' ELSE 'get' END"
_OPERATION = ("event_id", "ts", f"{_OP} AS op", "CAST(event_id * 7 % 30 AS STRING) AS key", "CASE WHEN user_id % 3 > 0 THEN CAST(user_id % 3 AS STRING) END AS owner", "CAST(event_id AS STRING) AS value")


def stream_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Entries live for half a day; a cache holds 20."""
    e = _events(spark, sf).selectExpr("CAST(user_id % 5 AS STRING) AS cache", *_OPERATION)
    return _finished(machines.cached_values(e, 43_200, 20), "append", "cache").select("cache", "event_id", "op", "found", "size")


def _rows(spark, sf):
    return _statements(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def export_ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    return exports.ledger_rows(_rows(spark, sf))


def ledger_with_total(spark: SparkSession, sf: str) -> DataFrame:
    out = exports.with_total(_rows(spark, sf))
    return out.select("doc_id", "row_no", "date", "description", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


def _entries(spark, sf):
    """Entries of all statements, every third without a reference."""
    rows = _rows(spark, sf).withColumn("reference", F.when(F.col("row_no") % 3 == 0, "").otherwise(F.col("reference")))
    return exports.signed_rows(rows)


NOW = "20260301101500"


def ofx_rows(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf)
    documents = entries.groupBy("doc_id").agg(F.sum("amount").alias("closing")).select("doc_id", "closing", F.lit("eur").alias("currency"), F.lit("First & Savings").alias("bank_name"), F.lit("XX-12 34").alias("account"))
    return exports.ofx_lines(entries, documents, NOW, qbo=True)


def qif_rows(spark: SparkSession, sf: str) -> DataFrame:
    return exports.qif_lines(_entries(spark, sf))


QUERIES = (
    stream_job_latest, stream_completion, stream_quota, stream_rate_limit, stream_progress, stream_job_machine, stream_claims, stream_buffers, stream_cache, buffer_latest, export_ledger_rows, ledger_with_total, ofx_rows, qif_rows,
)

_TERMINAL = "('completed', 'failed', 'cancelled')"
_AMOUNT = "(CASE WHEN coalesce(credit, 0) > 0 THEN credit ELSE -coalesce(debit, 0) END)::DECIMAL(28,2)"
_REFERENCE = "CASE WHEN row_no % 3 = 0 THEN '' ELSE reference END"
_FLOAT = "regexp_replace(regexp_replace(amount::DECIMAL(28,6)::VARCHAR, '0+$', ''), '\\.$', '.0')"
_QUOTED = lambda lines: "[" + ", ".join(x if x.startswith("'<") is False and "||" in x else f"'{x}'" for x in lines) + "]"
_OFX_HEAD = _QUOTED([*exports.OFX_HEAD, "  <SIGNONMSGSRSV1>", "    <SONRS>", *exports._STATUS, f"      <DTSERVER>{NOW}", "      <LANGUAGE>ENG", "        <INTU.BID>3000", "    </SONRS>", "  </SIGNONMSGSRSV1>", "  <BANKMSGSRSV1>", "    <STMTTRNRS>",
    "'      <TRNUID>' || doc_id", *exports._STATUS, "      <STMTRS>", "        <CURDEF>EUR", "        <BANKACCTFROM>", "          <BANKID>FIRSTSAV", "          <ACCTID>XX1234", "          <ACCTTYPE>CHECKING",
    "        </BANKACCTFROM>", "        <BANKTRANLIST>", "'          <DTSTART>' || first_day", "'          <DTEND>' || last_day"])
_OFX_FOOT = _QUOTED(["        </BANKTRANLIST>", "        <LEDGERBAL>", "'          <BALAMT>' || closing::DECIMAL(28,2)::VARCHAR", "'          <DTASOF>' || last_day", "        </LEDGERBAL>", "      </STMTRS>", "    </STMTTRNRS>", "  </BANKMSGSRSV1>", "</OFX>"])
_PAIRS = " OR ".join(f"wanted = '{to}' AND status IN ({', '.join(repr(x) for x in came)})" for to, came in stream.TRANSITIONS.items())
_WATERMARK = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"
SQL = {
    "stream_progress": f"""WITH e AS (SELECT (user_id % 50)::VARCHAR AS job_id, event_id, ts, {_CASE_STATUS} AS status, (event_id % 12 + 1)::INT AS p FROM events)
SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max((p * 100 // 12)::INT, (ts, event_id)) AS progress, arg_max('Completed Part ' || p || ' of 12', (ts, event_id)) AS message, count(*) AS n_events, sum(event_id)::BIGINT AS ids FROM e GROUP BY job_id""",
    "stream_job_machine": f"""WITH RECURSIVE e AS (SELECT event_id // 8 AS job, event_id, ts, {_CASE_STATUS} AS wanted, row_number() OVER (PARTITION BY event_id // 8 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT job, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS status, NULL::VARCHAR AS verdict, NULL::TIMESTAMP AS opened FROM e
  UNION ALL SELECT job, n, event_id, ts, CASE WHEN verdict = 'ok' THEN wanted ELSE status END, verdict, coalesce(opened, CASE WHEN verdict = 'ok' THEN ts END) FROM (SELECT r.job, e.n, e.event_id, e.ts, e.wanted, r.status, r.opened,
    CASE WHEN r.opened IS NULL THEN CASE WHEN wanted = 'queued' THEN 'ok' ELSE 'unknown' END WHEN status IN {_TERMINAL} THEN 'ended' WHEN wanted = status OR {_PAIRS} THEN 'ok' ELSE 'illegal' END AS verdict FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1)),
o AS (SELECT job, max(opened) AS opened, max(ts) AS last FROM r GROUP BY job),
l AS (SELECT r.job, arg_max(status, n) AS status FROM r JOIN o ON o.job = r.job WHERE ts <= o.opened + INTERVAL 1800 SECONDS GROUP BY r.job)
SELECT job::VARCHAR AS job_id, event_id, status, verdict, verdict = 'ok' AND ts <= opened + INTERVAL 1800 SECONDS AS delivered FROM r WHERE n > 0
UNION ALL SELECT o.job::VARCHAR, NULL, status, 'timeout', TRUE FROM o JOIN l ON l.job = o.job WHERE status NOT IN {_TERMINAL} AND (last > opened + INTERVAL 1800 SECONDS OR {_WATERMARK} >= opened + INTERVAL 1800 SECONDS)""",
    "stream_claims": f"""WITH RECURSIVE e AS (SELECT event_id // 12 AS rec, event_id, ts, {_KINDS} AS kind, (user_id % 3)::VARCHAR AS worker, row_number() OVER (PARTITION BY event_id // 12 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT rec, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS kind, NULL::VARCHAR AS worker, NULL::VARCHAR AS verdict, FALSE AS bank, FALSE AS ledger, 'processing' AS status, NULL::TIMESTAMP AS claimed FROM e
  UNION ALL SELECT rec, n, event_id, ts, kind, worker, verdict, bank OR kind = 'bank', ledger OR kind = 'ledger', CASE WHEN verdict IN ('completed', 'failed') THEN verdict ELSE status END, CASE WHEN verdict = 'granted' THEN ts ELSE claimed END
  FROM (SELECT r.rec, e.n, e.event_id, e.ts, e.kind, e.worker, r.bank, r.ledger, r.status, r.claimed, CASE e.kind WHEN 'bank' THEN CASE WHEN bank THEN 'repeated' WHEN ledger THEN 'ready' ELSE 'waiting' END WHEN 'ledger' THEN CASE WHEN ledger THEN 'repeated' WHEN bank THEN 'ready' ELSE 'waiting' END
    WHEN 'claim' THEN CASE WHEN status <> 'processing' THEN 'over' WHEN NOT (bank AND ledger) THEN 'early' WHEN claimed >= e.ts - INTERVAL 600 SECONDS THEN 'held' ELSE 'granted' END
    WHEN 'done' THEN CASE status WHEN 'completed' THEN 'over' ELSE 'completed' END ELSE CASE status WHEN 'processing' THEN 'failed' ELSE 'over' END END AS verdict FROM r JOIN e ON e.rec = r.rec AND e.n = r.n + 1))
SELECT rec::VARCHAR AS rec_id, event_id, kind, worker, verdict FROM r WHERE n > 0
UNION ALL SELECT rec::VARCHAR, NULL, 'claim', worker, 'expired' FROM r g WHERE verdict = 'granted' AND NOT EXISTS (SELECT 1 FROM r d WHERE d.rec = g.rec AND d.n > g.n AND d.verdict IN ('completed', 'failed') AND d.ts <= g.ts + INTERVAL 600 SECONDS)
  AND (g.ts + INTERVAL 600 SECONDS < {_WATERMARK} OR EXISTS (SELECT 1 FROM r d WHERE d.rec = g.rec AND d.ts > g.ts + INTERVAL 600 SECONDS))""",
    "stream_buffers": """WITH RECURSIVE e AS (SELECT user_id % 7 AS s, event_id, event_type = 'purchase' AS take, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT s, 0::BIGINT AS n, NULL::BIGINT AS event_id, FALSE AS take, NULL::BIGINT AS taken, []::BIGINT[] AS held, 0::BIGINT AS lost FROM e
  UNION ALL SELECT r.s, e.n, e.event_id, e.take, CASE WHEN e.take THEN held[1] END, CASE WHEN e.take THEN held[2:] WHEN len(held) >= 100 THEN list_append(held[2:], e.event_id) ELSE list_append(held, e.event_id) END, lost + CASE WHEN NOT e.take AND len(held) >= 100 THEN 1 ELSE 0 END
  FROM r JOIN e ON e.s = r.s AND e.n = r.n + 1)
SELECT s::VARCHAR AS subscriber, event_id, taken, len(held)::INT AS waiting, lost AS dropped FROM r WHERE take""",
    "stream_cache": f"""WITH RECURSIVE e AS (SELECT user_id % 5 AS c, {', '.join(_OPERATION).replace('STRING', 'VARCHAR')}, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT c, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS op, NULL::VARCHAR AS found, []::STRUCT(k VARCHAR, u TIMESTAMP, o VARCHAR, v VARCHAR)[] AS h FROM e
  UNION ALL SELECT c, n, event_id, op, CASE WHEN op = 'get' AND ts <= x.u AND mine THEN x.v END,
    CASE WHEN op = 'set' THEN list_append(list_filter(CASE WHEN len(alive) >= 20 THEN alive[2:] ELSE alive END, lambda y: y.k <> key), {{'k': key, 'u': ts + INTERVAL 12 HOURS, 'o': owner, 'v': value}})
      WHEN x IS NULL THEN h WHEN op = 'get' AND ts > x.u THEN others WHEN op = 'get' AND mine THEN list_append(others, x) WHEN op = 'delete' AND mine THEN others ELSE h END
  FROM (SELECT r.c, e.n, e.event_id, e.ts, e.op, e.key, e.owner, e.value, h, list_filter(h, lambda y: y.k = e.key)[1] AS x, list_filter(h, lambda y: y.k <> e.key) AS others, list_filter(h, lambda y: e.ts <= y.u) AS alive,
    coalesce(list_filter(h, lambda y: y.k = e.key)[1].o = e.owner, TRUE) AS mine FROM r JOIN e ON e.c = r.c AND e.n = r.n + 1))
SELECT c::VARCHAR AS cache, event_id, op, found, len(h)::INT AS size FROM r WHERE op <> 'set' AND n > 0""",
    "stream_job_latest": f"SELECT job_id, status, progress FROM (SELECT user_id % 50 AS job_id, {_CASE_STATUS} AS status, event_id AS progress, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "stream_completion": f"WITH e AS (SELECT user_id % 20 AS rec_id, {_CASE_STATUS} AS status, event_id % 2 = 0 AS bank FROM events), g AS (SELECT rec_id, bool_or(status = 'completed') FILTER (bank AND status IN {_TERMINAL}) AS b, bool_or(status = 'completed') FILTER (NOT bank AND status IN {_TERMINAL}) AS l FROM e GROUP BY rec_id) SELECT rec_id, b AND l AS ok FROM g WHERE b IS NOT NULL AND l IS NOT NULL",
    "stream_quota": "SELECT 'user' || (user_id % 20) AS email, sum(event_id % 12 - 2)::BIGINT AS pages FROM events WHERE event_id % 12 > 2 GROUP BY 1",
    "buffer_latest": "SELECT subscriber, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT user_id % 7 AS subscriber, event_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY subscriber",
    "export_ledger_rows": f"{_STATEMENTS} SELECT doc_id, row_no, strftime(date, '%Y-%m-%d') AS date, description, reference, coalesce(debit, 0)::DECIMAL(28,2)::VARCHAR AS debit, coalesce(credit, 0)::DECIMAL(28,2)::VARCHAR AS credit, {_CATEGORY} AS category FROM s",
    "ledger_with_total": f"{_STATEMENTS} SELECT doc_id, row_no, strftime(date, '%Y-%m-%d') AS date, description, debit::DOUBLE AS debit, credit::DOUBLE AS credit FROM s UNION ALL SELECT doc_id, max(row_no) + 1, NULL, 'TOTAL', sum(debit)::DOUBLE, sum(credit)::DOUBLE FROM s GROUP BY doc_id",
    "qif_rows": f"""{_STATEMENTS}, b AS (SELECT doc_id, row_no, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest(['D' || strftime(date, '%m/%d/%Y'), 'T' || {_AMOUNT}::VARCHAR, 'P' || description, nullif('N' || {_REFERENCE}, 'N'), 'L' || {_CATEGORY}, '^']) AS line FROM s
UNION ALL SELECT DISTINCT doc_id, -1, 0, '!Type:Bank' FROM s) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_no, k)::INT AS line_no, line FROM b WHERE line IS NOT NULL""",
    "ofx_rows": f"""{_STATEMENTS}, e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS n, strftime(date, '%Y%m%d') || '120000' AS day, {_AMOUNT} AS amount, replace(left(description, 32), '&', '&amp;') AS name,
  replace(left(coalesce(nullif({_REFERENCE}, ''), {_CATEGORY}), 32), '&', '&amp;') AS memo FROM s),
d AS (SELECT doc_id, arg_min(day, n) AS first_day, arg_max(day, n) AS last_day, sum(amount) AS closing FROM e GROUP BY doc_id),
b AS (SELECT doc_id, n, unnest(range(8)) AS k, unnest(['          <STMTTRN>', '            <TRNTYPE>' || CASE WHEN amount >= 0 THEN 'CREDIT' ELSE 'DEBIT' END, '            <DTPOSTED>' || day, '            <TRNAMT>' || amount::DECIMAL(28,2)::VARCHAR,
  '            <FITID>' || upper(left(md5(doc_id || '_' || n || '_' || day || '_' || {_FLOAT} || '_' || name), 16)), '            <NAME>' || name, '            <MEMO>' || memo, '          </STMTTRN>']) AS line FROM e
UNION ALL SELECT doc_id, -1, unnest(range({len(exports.OFX_HEAD) + 30})), unnest({_OFX_HEAD}) FROM d UNION ALL SELECT doc_id, 4611686018427387904, unnest(range(9)), unnest({_OFX_FOOT}) FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k)::INT AS line_no, line FROM b WHERE line IS NOT NULL""",
}

"""Queries of records, texts and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import balances, records
from . import driver_data as data
from .queries_documents import _JOBS, _jobs

_KINDS = ("spreadsheet", "pdf", "image")


def _of(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _recs(spark, sf):
    k = F.col("c_custkey")
    stage = F.when(k % 7 == 0, "reconciling")
    return data.load(spark, sf, "customer").select(
        k.alias("rec_id"), _of(_KINDS, k % 3).alias("bank_statement_kind"), _of(_KINDS, F.floor(k / 3) % 3).alias("general_ledger_kind"),
        _of(("queued", "processing", "completed", "failed"), k % 4).alias("status"), stage.alias("stage"), F.when(k % 7 == 0, 90).alias("progress"),
    )


def document_roles(spark: SparkSession, sf: str) -> DataFrame:
    return records.document_roles(_recs(spark, sf))


def reconciliation_progress(spark: SparkSession, sf: str) -> DataFrame:
    recs = _recs(spark, sf)
    roles = records.document_roles(recs)
    n, bank = F.col("rec_id"), F.col("role") == "bank_statement"
    jobs = roles.where("has_job").select(
        "document_id", _of(("queued", "processing", "completed", "failed", "cancelled"), (n + F.when(bank, 0).otherwise(2)) % 5).alias("status"), (n * 13 % 97).alias("progress"),
    )
    return records.progress(recs, roles, jobs)


def live_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of guests expire an hour after their last change; the newest change is now."""
    j = _jobs(spark, sf).select("job_id", "updated_at", F.lit(None).cast("timestamp").alias("expires_at"))
    guests = j.select("job_id", F.when(F.col("job_id") % 2 == 0, "user").alias("owner_id"), (F.col("updated_at") + F.make_dt_interval(hours=F.lit(1))).alias("expires_at"))
    now = j.agg(F.max("updated_at").alias("now"))
    return records.live(records.with_retention(j, guests, "job_id").crossJoin(F.broadcast(now)), F.col("now")).select("job_id", (F.col("expires_at").isNull()).alias("is_kept"))


def deleted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What stays after requests by owners, some of whom own other documents."""
    d = _jobs(spark, sf).select(F.col("job_id").alias("document_id"), "owner")
    asked = d.where("document_id % 3 = 0").select("document_id", F.when(F.col("document_id") % 2 == 0, F.lit("user3")).alias("owner"))
    docs, extractions = records.deleted(d, d, asked)
    return docs.select("document_id", F.lit("document").alias("of")).unionByName(extractions.select("document_id", F.lit("extraction").alias("of")))


def new_jobs(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf).select("job_id", F.when(F.col("job_id") % 4 != 0, F.concat(F.lit(" "), F.upper("owner"))).alias("user_email"), F.when(F.col("job_id") % 5 == 0, F.lit("de")).alias("language"))
    return records.new_jobs(j, F.lit("2026-01-01").cast("timestamp")).select("job_id", "user_email", "language", "status", "progress", "message", "clean_with_ai", "document_type")


def job_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("job_id", records.can_cancel(F.col("status")).alias("can_cancel"), records.can_retry(F.col("status")).alias("can_retry"))


def receipt_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = data.load(spark, sf, "part")
    return records.summary_lines(p.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("merchant"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("").alias("receipt_number"), F.lit("2026-02-03").alias("date"),
        F.lit(None).cast("string").alias("currency"), F.when(F.col("p_size") % 3 != 0, F.format_string("%.2f", F.col("p_retailprice"))).alias("total"), F.lit("card").alias("payment_method"),
    ), "receipt")


def line_positions(spark: SparkSession, sf: str) -> DataFrame:
    li = data.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("inv_id"), "l_linenumber", "l_partkey", "l_suppkey").groupBy("inv_id", F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("p"))
    return records.numbered(li.select("inv_id", "idx", F.when(F.col("p") % 3 == 0, F.lit("2")).when(F.col("p") % 3 == 1, F.lit("")).alias("position")))


def latest_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    log = data.load(spark, sf, "events").select((F.col("user_id") % 20).alias("job_id"), F.col("ts").alias("delivered_at"), F.col("event_id").alias("delivery_id"))
    return records.latest_deliveries(log).select("job_id", "delivery_id")


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = data.load(spark, sf, "conversations")
    lines = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 4 - 1).alias("page"), (F.col("turn") + 1).alias("place"), F.when(F.col("turn") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "role", F.lit(" "))).alias("text"), (F.col("turn") * 0.30001 - 0.5).alias("confidence"))
    return records.page_lines(lines)


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return data.load(spark, sf, "pages").select("page_id", records.request_id(u).alias("request_id"), records.file_stem(u).alias("stem"), records.stored_name(u).alias("stored"))


def payment_texts(spark: SparkSession, sf: str) -> DataFrame:
    c, k = data.load(spark, sf, "customer"), F.col("c_custkey")
    gap = lambda n, v: F.when(k % n != 0, v)
    return c.select(
        k.alias("inv_id"), records.payment_terms(gap(5, (k % 30).cast("int")), gap(7, (k % 4).cast("decimal(10,2)")), gap(3, F.lit("net 30 days"))).alias("terms"),
        records.legal_text(gap(2, F.lit("A. B.")), gap(3, F.lit("HRB 12")), gap(4, F.lit("Berlin")), F.when(k % 5 == 0, F.lit("see HRB 12")).when(k % 5 == 1, F.lit("more"))).alias("legal"),
        records.snapped(k * 0.1 * 3, 2).alias("snapped"),
    )


def invoice_entries(spark: SparkSession, sf: str) -> DataFrame:
    o, k = data.load(spark, sf, "orders"), F.col("o_orderkey")
    d = o.select(
        k.alias("doc_id"), F.when(k % 2 == 0, "invoice").otherwise("receipt").alias("kind"), F.when(k % 3 != 0, k.cast("string")).alias("number"), F.to_date("o_orderdate").alias("date"), F.when(k % 11 != 0, -F.col("o_totalprice")).cast("decimal(28,3)").alias("total"),
        F.when(k % 4 == 0, "payable").when(k % 4 == 1, "receivable").alias("direction"), F.lit("Seller").alias("seller"), F.when(k % 8 == 1, "Buyer").alias("buyer"), (k % 13 != 0).alias("is_printed"),
    )
    return records.invoice_entries(d).withColumn("amount", F.col("amount").cast("double"))


def book_to_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries made from customers; each order is an unmatched row of one side or a difference."""
    k, m = F.col("c_custkey"), lambda c: c.cast("decimal(28,3)")
    c = data.load(spark, sf, "customer")
    bank = c.select(k.alias("rec_id"), m(F.col("c_acctbal")).alias("opening"), m(F.col("c_acctbal") + 10).alias("closing"))
    ledger = c.where("c_custkey % 9 != 0").select(k.alias("rec_id"), m(F.lit(0)).alias("opening"), m(k).alias("closing"))
    o = data.load(spark, sf, "orders").select(F.col("o_custkey").alias("rec_id"), m(F.col("o_totalprice")).alias("effect"), (F.col("o_orderkey") % 3).alias("part"))
    out = balances.book_to_bank(bank, ledger, o.where("part = 0"), o.where("part = 1"), o.where("part = 2").withColumnRenamed("effect", "difference"))
    return out.select("rec_id", F.col("explained").cast("double").alias("explained"), F.col("unexplained").cast("double").alias("unexplained"))


QUERIES = (
    document_roles, reconciliation_progress, live_jobs, deleted_documents, new_jobs, job_actions, receipt_summary, line_positions, latest_deliveries, page_lines, safe_names, payment_texts, invoice_entries, book_to_bank,
)

_ROLES = f"""WITH c AS (SELECT c_custkey AS k, list_extract({list(_KINDS)}, CAST(c_custkey % 3 AS INT) + 1) AS bk, list_extract({list(_KINDS)}, CAST(c_custkey // 3 % 3 AS INT) + 1) AS lk FROM customer),
r AS (SELECT k AS rec_id, 'bank_statement' AS role, bk AS kind, k || '_bank' AS document_id, bk <> 'spreadsheet' AS has_job FROM c UNION ALL SELECT k, 'general_ledger', lk, k || '_ledger', lk <> 'spreadsheet' FROM c)"""
_DROP = "regexp_replace(url, '[^a-zA-Z0-9_{}-]', '', 'g')"
SQL = {
    "document_roles": f"{_ROLES} SELECT * FROM r",
    "reconciliation_progress": f"""{_ROLES}, j AS (SELECT *, list_extract(['queued','processing','completed','failed','cancelled'], CAST((rec_id + CASE role WHEN 'bank_statement' THEN 0 ELSE 2 END) % 5 AS INT) + 1) AS s FROM r),
t AS (SELECT rec_id, sum(CASE WHEN NOT has_job OR s NOT IN ('queued', 'processing') THEN 100 ELSE rec_id * 13 % 97 END) AS total, count(*) FILTER (has_job AND s IN ('queued', 'processing')) AS pending, count(*) FILTER (has_job AND s <> 'queued') AS running FROM j GROUP BY rec_id),
x AS (SELECT *, list_extract(['queued','processing','completed','failed'], CAST(rec_id % 4 AS INT) + 1) AS st, rec_id % 7 = 0 AS late FROM t),
y AS (SELECT *, st IN ('queued', 'processing') AND NOT late AS ex FROM x), z AS (SELECT *, CASE WHEN ex AND (pending = 0 OR running > 0) THEN 'processing' ELSE st END AS status FROM y)
SELECT rec_id, status, CAST(CASE WHEN status = 'completed' THEN 100 WHEN ex AND pending > 0 AND status = 'queued' THEN 0 WHEN ex THEN 5 + floor(CAST(total AS DOUBLE) / 2 * 0.8) WHEN late THEN 90 ELSE 0 END AS BIGINT) AS progress FROM z""",
    "live_jobs": f"{_JOBS} SELECT job_id, job_id % 2 = 0 AS is_kept FROM j WHERE job_id % 2 = 0 OR updated_at + INTERVAL 1 HOUR > (SELECT max(updated_at) FROM j)",
    "deleted_documents": f"{_JOBS} SELECT job_id AS document_id, 'document' AS of FROM j WHERE NOT (job_id % 3 = 0 AND (job_id % 2 = 1 OR owner = 'user3')) UNION ALL SELECT job_id, 'extraction' FROM j WHERE job_id % 3 <> 0",
    "new_jobs": f"{_JOBS} SELECT job_id, CASE WHEN job_id % 4 <> 0 THEN owner ELSE 'guest' END AS user_email, CASE WHEN job_id % 5 = 0 THEN 'de' ELSE 'en' END AS language, 'queued' AS status, 0 AS progress, 'Job queued for processing' AS message, TRUE AS clean_with_ai, 'auto' AS document_type FROM j",
    "job_actions": f"{_JOBS} SELECT job_id, status IN ('queued', 'processing') AS can_cancel, status IN ('failed', 'cancelled') AS can_retry FROM j",
    "receipt_summary": """SELECT p_partkey AS doc_id, 1 AS line_no, 'Merchant' AS label, p_brand AS value FROM part WHERE p_brand <> '' UNION ALL SELECT p_partkey, 2, 'Receipt #', p_partkey::VARCHAR FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 3, 'Date', '2026-02-03' FROM part
UNION ALL SELECT p_partkey, 5, 'Total Amount', format('{:,.2f}', p_retailprice) FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, 6, 'Payment Method', 'card' FROM part""",
    "line_positions": """WITH l AS (SELECT l_orderkey AS inv_id, l_linenumber AS idx, min(l_partkey) AS p FROM lineitem GROUP BY ALL), n AS (SELECT inv_id, idx, CASE WHEN p % 3 = 0 THEN '2' ELSE idx::VARCHAR END AS position FROM l)
SELECT *, row_number() OVER (PARTITION BY inv_id, position ORDER BY idx) > 1 AS is_repeat FROM n""",
    "latest_deliveries": "SELECT user_id % 20 AS job_id, event_id AS delivery_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) <= 100",
    "page_lines": "SELECT conv_id AS doc_id, CASE WHEN turn % 4 - 1 > 0 THEN turn % 4 - 1 ELSE turn + 1 END AS page, turn + 1 AS place, trim(role) AS text, least(greatest(round(turn * 0.30001::DOUBLE - 0.5::DOUBLE, 4), 0.0), 1.0) AS confidence FROM conversations WHERE turn % 5 <> 0 AND trim(role) <> ''",
    "safe_names": f"""WITH p AS (SELECT page_id, {_DROP.format('.:')} AS a, {_DROP.format('')} AS b, regexp_extract(coalesce(url, ''), '([^/]*)$', 1) AS t FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN t = '' THEN 'file' ELSE t END, '[^A-Za-z0-9._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM p)
SELECT page_id, nullif(a, '') AS request_id, coalesce(nullif(b, ''), 'document') AS stem, left(coalesce(nullif(s, ''), 'file'), 120) AS stored FROM q""",
    "payment_texts": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 'net 30 days' END AS t, CASE c_custkey % 5 WHEN 0 THEN 'see HRB 12' WHEN 1 THEN 'more' END AS m FROM customer)
SELECT k AS inv_id, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN t ELSE '#SKONTO#TAGE=' || (k % 30) || '#PROZENT=' || (k % 4) || '.00#' || coalesce(chr(10) || t, '') || chr(10) END AS terms,
nullif(concat_ws(', ', CASE WHEN k % 2 <> 0 THEN 'Geschäftsführer: A. B.' END, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'Handelsregister: HRB 12' || CASE WHEN k % 4 <> 0 THEN ', Berlin' ELSE '' END END, m), '') AS legal, (k * 3)::DOUBLE / 10 AS snapped FROM c""",
    "invoice_entries": """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, o_totalprice AS t FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_totalprice <> 0)
SELECT k AS doc_id, date, CASE WHEN k % 2 = 0 THEN 'Invoice' ELSE 'Receipt' END || CASE WHEN k % 3 <> 0 THEN ' ' || k ELSE '' END || CASE WHEN k % 4 <> 1 THEN ' - Seller' WHEN k % 8 = 1 THEN ' - Buyer' ELSE '' END AS description,
CASE WHEN k % 3 <> 0 THEN k::VARCHAR END AS reference, CAST(t AS DECIMAL(28,3))::DOUBLE AS amount, CASE WHEN k % 4 = 1 THEN 'credit' ELSE 'debit' END AS type, k % 4 > 1 AS is_direction_unknown FROM o""",
    "book_to_bank": """WITH o AS (SELECT o_custkey AS rec_id, sum(CASE o_orderkey % 3 WHEN 1 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(28,3))) AS e FROM orders GROUP BY 1)
SELECT c_custkey AS rec_id, coalesce(e, 0)::DOUBLE AS explained, CASE WHEN c_custkey % 9 <> 0 THEN (10 - c_custkey - coalesce(e, 0))::DOUBLE END AS unexplained FROM customer LEFT JOIN o ON c_custkey = rec_id""",
}

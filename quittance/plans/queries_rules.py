"""Queries of invoice header rules, upserts, caches, audits and layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import documents, einvoice, jobs, layout, lenient
from ..streaming import jobs as stream
from . import driver_data as data
from .queries_documents import _JOBS, _jobs

_CATEGORIES = ("S", "AE", "K", "O", "E", "G")
_TYPES = ("380", "381", "384", "999")


def header_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Headers made from customers, with gaps by key."""
    c, k = data.load(spark, sf, "customer"), F.col("c_custkey")
    gap = lambda n, value: F.when(k % n != 0, F.lit(value))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    day = F.lit("2026-01-10").cast("date")
    h = c.select(
        k.alias("inv_id"), F.array(of(_CATEGORIES)).alias("categories"), gap(2, "DE123456789").alias("seller_vat_id"), gap(4, "12/345").alias("seller_tax_number"), gap(3, "DE999999999").alias("buyer_vat_id"),
        F.lit(None).cast("string").alias("buyer_legal_id"), F.when(k % 5 != 0, day).alias("delivery_date"), F.lit(None).cast("date").alias("billing_period_start"), F.col("c_acctbal").alias("payable_amount"),
        F.when(k % 6 != 0, F.date_add(day, (k % 7 - 2).cast("int"))).alias("due_date"), F.lit(None).cast("string").alias("terms"), of(("58", "1", "59")).alias("means_code"), gap(7, "DE89370400440532013000").alias("iban"),
        day.alias("issue_date"), F.lit(None).cast("string").alias("seller_id"), of(_TYPES).alias("type_code"), F.lit(None).cast("string").alias("preceding_invoice"), (k % 2 == 1).alias("is_xrechnung"),
        gap(9, "04011000-1234512345-06").alias("buyer_reference"), gap(8, "Name").alias("seller_contact_name"), F.lit(None).cast("string").alias("mandate_reference"),
        F.when(k % 10 == 0, "FR").otherwise("DE").alias("seller_country"), F.lit("AT").alias("buyer_country"), gap(11, "Street 1").alias("seller_street"), gap(12, "10115").alias("seller_postcode"), gap(13, "Berlin").alias("seller_city"),
        gap(14, "Street 2").alias("buyer_street"), gap(15, "1010").alias("buyer_postcode"), gap(16, " ").alias("buyer_city"),
        *[F.lit(v).alias(c) for c, v in data.HEADER.items()],
    )
    return einvoice.header_issues(h).select("inv_id", "rule_id", "field", "severity")


def upserted_rows(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf).select((F.col("job_id") % 300).alias("document_id"), "filename", F.struct("updated_at", "job_id").alias("version"), "updated_at")
    latest = jobs.upserted(j.where("version.job_id % 2 = 0"), j.where("version.job_id % 2 = 1"), "document_id", "version")
    return latest.select("document_id", "filename")


def cached_results(spark: SparkSession, sf: str) -> DataFrame:
    e = _jobs(spark, sf).select(F.col("job_id").alias("key"), F.col("updated_at").alias("stored_at"), F.col("updated_at").alias("used_at"))
    now = e.agg(F.max("stored_at").alias("now"))
    return stream.cached(e.crossJoin(F.broadcast(now)), F.col("now"), 86_400, 50).select("key")


def invoice_audit(spark: SparkSession, sf: str) -> DataFrame:
    """subtotal + tax against totals that are off by 0.05 or 0.06 for some."""
    o, k = data.load(spark, sf, "orders"), F.col("o_orderkey")
    off = F.when(k % 3 == 0, F.lit("0.05")).when(k % 3 == 1, F.lit("0.06")).otherwise(F.lit("0.00")).cast("decimal(10,2)")
    money = lambda c: c.cast("decimal(18,2)")
    d = o.select(k.alias("doc_id"), money(F.col("o_totalprice")).alias("subtotal"), money(F.lit(7)).alias("tax"), F.lit(None).cast("decimal(18,2)").alias("discount"), money(money(F.col("o_totalprice")) + 7 + off).alias("total"))
    return documents.total_audit(d).select("doc_id", F.col("expected").cast("double").alias("expected"), F.col("total").cast("double").alias("total"), "ok")


def item_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items printed as piped rows and read back."""
    p = data.load(spark, sf, "part")
    text = F.concat(F.lit("| item | total |\n| "), F.col("p_name"), F.lit(" | 1 | "), F.format_string("%.2f", "p_retailprice"), F.lit(" |\n| no amount | x |"))
    return documents.item_lines(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    li = data.load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 37 + 1).alias("page")).distinct()
    return layout.page_parts(li)


def engine_routes(spark: SparkSession, sf: str) -> DataFrame:
    p = data.load(spark, sf, "part")
    route = layout.engine(F.when(F.col("p_size") % 5 == 0, "image").otherwise("pdf"), F.col("p_size") * 2, F.col("p_retailprice") % 60, F.col("p_partkey") % 2 == 0)
    return p.groupBy(route.alias("engine")).agg(F.count(F.lit(1)).alias("n"))


def typed_props(spark: SparkSession, sf: str) -> DataFrame:
    """The events' properties, damaged by kind: cut off, a text for the number, a name that is a number."""
    e, props = data.load(spark, sf, "events"), F.col("props")
    kind = lambda k: F.col("event_type") == k
    damaged = F.when(kind("error"), F.substring(props, F.lit(1), F.length(props) - 1)).when(kind("signup"), F.regexp_replace(props, r"\d+", '"many"')).when(kind("click"), F.concat(F.substring(props, F.lit(1), F.length(props) - 1), F.lit(', "name": 5}'))).otherwise(props)
    typed = lenient.typed(e.select("event_id", damaged.alias("json")), "k double, name string")
    return typed.select("event_id", F.col("value.k").alias("k"), F.array_join("deviating", ",").alias("deviating"), F.col("warning.code").alias("code"), F.col("warning.line").alias("line"), F.col("warning.column").alias("place"))


def _printed(spark, sf):
    """Orders as printed invoices, with a line for each of theirs; the customer's name stands as the merchant."""
    li = data.load(spark, sf, "lineitem")
    money = lambda c: F.format_number(F.col(c), 2)
    line = F.concat(F.lit("| Part "), F.col("l_partkey").cast("string"), F.lit(" | "), F.when(F.col("l_linenumber") % 4 == 0, F.lit("some")).otherwise(F.format_string("%d pcs", F.col("l_quantity").cast("bigint"))), F.lit(" | "), money("l_extendedprice"), F.lit(" |"))
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    o = data.load(spark, sf, "orders").join(data.load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat(F.lit("Invoice No: INV-"), F.col("o_orderkey").cast("string"), F.lit("\nInvoice Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nMerchant: "), F.col("c_mktsegment"), F.lit("\n| Item | Qty | Amount |\n|---|---|---|\n"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(head, F.coalesce("lines", F.lit("")), F.when(F.col("o_orderstatus") == "P", "\nopen").otherwise(F.concat(F.lit("\nTotal: EUR "), money("o_totalprice")))).alias("text"))


def printed_invoice_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = _printed(spark, sf)
    return documents.labelled(docs, "invoice").join(documents.labelled(docs, "receipt").select("doc_id", "merchant", F.col("date").alias("receipt_date")), "doc_id")


def printed_invoice_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents.invoice_lines(_printed(spark, sf)).select("doc_id", "description", "quantity", "amount")


QUERIES = (printed_invoice_fields, printed_invoice_lines, typed_props, header_rules, upserted_rows, cached_results, invoice_audit, item_lines, page_chunks, engine_routes)

_H = f"""WITH c AS (SELECT c_custkey AS k, c_acctbal AS pay FROM customer),
h AS (SELECT k AS inv_id, list_extract({list(_CATEGORIES)}, CAST(k % 6 AS INT) + 1) AS cat, k % 2 = 0 AS no_vat, k % 2 = 0 AND k % 4 = 0 AS unreg, k % 3 = 0 AS no_buyer_vat, k % 5 = 0 AS undelivered, pay, k % 6 = 0 AS no_due,
  DATE '2026-01-10' + CAST(k % 7 - 2 AS INT) AS due, list_extract(['58', '1', '59'], CAST(k % 3 AS INT) + 1) AS means, list_extract({list(_TYPES)}, CAST(k % 4 AS INT) + 1) AS type, k % 2 = 1 AS x, k FROM c)"""
_RULES = [
    ("cat IN ('S', 'E') AND unreg", "'BR-' || cat || '-02'", "seller.vat_id", "'error'"), ("cat = 'AE' AND unreg", "'BR-AE-02'", "seller.vat_id", "'error'"), ("cat = 'AE' AND no_buyer_vat", "'BR-AE-02'", "buyer.vat_id", "'error'"),
    ("cat = 'K' AND no_vat", "'BR-IC-02'", "seller.vat_id", "'error'"), ("cat = 'K' AND no_buyer_vat", "'BR-IC-02'", "buyer.vat_id", "'error'"), ("cat = 'K' AND undelivered", "'BR-IC-11'", "delivery_date", "'error'"), ("cat = 'G' AND no_vat", "'BR-G-02'", "seller.vat_id", "'error'"),
    ("cat = 'O' AND NOT (no_vat AND no_buyer_vat)", "'BR-O-02'", "seller.vat_id", "'error'"), ("pay > 0 AND no_due", "'BR-CO-25'", "payment.due_date", "'error'"), ("means = '58' AND k % 7 = 0", "'BR-61'", "payment.iban", "'error'"),
    ("NOT no_due AND due < DATE '2026-01-10'", "'DE-DUE-DATE'", "payment.due_date", "'warning'"), ("no_vat", "'BR-CO-26'", "seller.vat_id", "'error'"), ("undelivered", "'DE-UStG-14-DELIVERY'", "delivery_date", "'warning'"),
    ("type IN ('381', '384')", "'DE-PRECEDING-INVOICE'", "preceding_invoice_number", "'warning'"), ("x AND type = '999'", "'BR-DE-17'", "type_code", "'error'"), ("x AND k % 9 = 0", "'BR-DE-15'", "buyer.buyer_reference", "'error'"),
    ("x AND k % 8 = 0", "'BR-DE-5'", "seller.contact.name", "'error'"), ("x AND unreg", "'BR-DE-16'", "seller.vat_id", "'error'"), ("x AND means = '59'", "'SEPA-MANDATE'", "payment.mandate_reference", "'error'"),
]
for _n, _role, _part, _rule in ((11, "seller", "street", None), (12, "seller", "postcode", "BR-DE-4"), (13, "seller", "city", "BR-DE-3"), (14, "buyer", "street", None), (15, "buyer", "postcode", "BR-DE-9"), (16, "buyer", "city", "BR-DE-8")):
    _gone = "TRUE" if (_role, _part) == ("buyer", "city") else f"k % {_n} = 0"
    _loose = "CASE WHEN k % 10 = 0 THEN 'warning' ELSE 'error' END" if _role == "seller" else "'warning'"
    _RULES.append((_gone, f"CASE WHEN x AND {_rule is not None} THEN '{_rule}' ELSE 'DE-UStG-14-ADDRESS' END", f"{_role}.address.{_part}", f"CASE WHEN x AND {_rule is not None} THEN 'error' ELSE {_loose} END"))
SQL = {
    "printed_invoice_fields": "SELECT o_orderkey AS doc_id, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total, c_mktsegment AS merchant, strftime(o_orderdate, '%Y-%m-%d') AS receipt_date FROM orders JOIN customer ON c_custkey = o_custkey",
    "printed_invoice_lines": "SELECT l_orderkey AS doc_id, 'Part ' || l_partkey AS description, CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE floor(l_quantity) END::DOUBLE AS quantity, l_extendedprice AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey",
    "typed_props": f"""SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN regexp_extract(props, '\\d+')::DOUBLE END AS k, CASE event_type WHEN 'signup' THEN 'k' WHEN 'click' THEN 'name' ELSE '' END AS deviating,
CASE WHEN event_type = 'error' THEN '{lenient.BROKEN}' WHEN event_type IN ('signup', 'click') THEN '{lenient.DEVIATES}' END AS code, CASE WHEN event_type = 'error' THEN 1 END AS line, CASE WHEN event_type = 'error' THEN length(props)::INT END AS place FROM events""",
    "header_rules": f"{_H} " + " UNION ALL ".join(f"SELECT inv_id, {r} AS rule_id, '{f}' AS field, {s} AS severity FROM h WHERE {w}" for w, r, f, s in _RULES),
    "upserted_rows": f"{_JOBS} SELECT job_id % 300 AS document_id, arg_max(filename, (updated_at, job_id)) AS filename FROM j GROUP BY 1",
    "cached_results": f"{_JOBS} SELECT job_id AS key FROM j WHERE updated_at > (SELECT max(updated_at) FROM j) - INTERVAL 1 DAY ORDER BY updated_at DESC, job_id LIMIT 50",
    "invoice_audit": "WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(18,2)) + 7 AS e, CASE o_orderkey % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.06 ELSE 0 END AS off FROM orders) SELECT doc_id, e::DOUBLE AS expected, (e + off)::DOUBLE AS total, off <= 0.05 AS ok FROM o",
    "item_lines": "SELECT p_partkey AS doc_id, 1 AS line_no, p_name AS description, CAST(p_retailprice AS DECIMAL(18,2))::DOUBLE AS total FROM part",
    "page_chunks": "SELECT l_suppkey AS doc_id, ceil((l_orderkey % 37 + 1) / 10)::BIGINT AS part, min(l_orderkey % 37 + 1) AS first_page, max(l_orderkey % 37 + 1) AS last_page FROM lineitem GROUP BY 1, 2",
    "engine_routes": "SELECT CASE WHEN p_size % 5 = 0 OR p_retailprice % 60 < 30 THEN 'ocr' WHEN p_partkey % 2 = 0 AND p_size * 2 <= 50 THEN 'layout' ELSE 'text' END AS engine, count(*) AS n FROM part GROUP BY 1",
}

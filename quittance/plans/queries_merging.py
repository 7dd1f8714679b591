"""Queries of merged part extractions: the parts are orders, order lines, events and turns, whole tables; with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import merging
from . import driver_data as data


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _when(condition: str, value: Column | str, otherwise: Column | None = None) -> Column:
    made = F.when(F.expr(condition), F.lit(value) if isinstance(value, str) else value)
    return made.otherwise(otherwise) if otherwise is not None else made


def _statements(spark, sf):
    """A statement per customer, a part per order, a transaction per line. Finished orders print no bank, open ones no period."""
    li = data.load(spark, sf, "lineitem")
    row = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", _day("l_shipdate").alias("date"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description"), F.col("l_returnflag").alias("reference"),
        _when("l_returnflag = 'R'", F.col("l_extendedprice")).alias("debit"), _when("l_returnflag <> 'R'", F.col("l_extendedprice")).alias("credit"),
    )
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("transactions"))
    total = F.col("o_totalprice")
    fields = [
        _when("o_orderstatus = 'F'", "", _when("o_orderstatus = 'O'", F.col("o_orderpriority"))).alias("bank_name"), _when("o_orderpriority > '3'", F.concat(F.lit("Holder "), F.col("o_custkey").cast("string"))).alias("account_holder"),
        _when("o_totalprice > 200000", "EUR", F.lit("")).alias("currency"), _when("o_orderstatus <> 'O'", _day("o_orderdate")).alias("statement_period"),
        _when("o_orderstatus = 'O'", total).alias("opening_balance"), _when("o_orderstatus <> 'P'", total).alias("closing_balance"), "transactions",
    ]
    orders = data.load(spark, sf, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("part"), F.struct(*fields).alias("extraction"))


def merged_statements(spark: SparkSession, sf: str) -> DataFrame:
    whole = merging.audited(merging.merged(_statements(spark, sf), "bank_statement"), "bank_statement")
    x = F.col("extraction")
    return whole.select(
        "doc_id", "parts", *[x[c].alias(c) for c in ("bank_name", "account_holder", "currency", "statement_period", "opening_balance", "closing_balance")],
        F.size(x["transactions"]).cast("bigint").alias("n_rows"), F.try_element_at(x["transactions"], F.lit(1))["description"].alias("first_row"), F.try_element_at(x["transactions"], F.lit(-1))["description"].alias("last_row"),
        F.col("warning.code").alias("code"), F.col("warning.message").alias("message"),
    )


def merged_statement_rows(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merged_rows(_statements(spark, sf), "bank_statement").select("doc_id", "row_no", "part", "date", "description", "reference", "debit", "credit")


def _invoices(spark, sf):
    """An invoice per order, a part per line, its supplier's details spread over the parts."""
    li = data.load(spark, sf, "lineitem").join(data.load(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    supplier = F.struct(_when("l_returnflag = 'A'", F.col("s_name"), F.lit("")).alias("name"), _when("l_linestatus = 'F'", F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))).alias("tax_id"))
    item = F.struct(F.col("l_partkey").cast("string").alias("description"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax_rate"), F.col("l_extendedprice").alias("amount"))
    fields = [
        _when("l_linestatus = 'O'", F.concat(F.lit("INV-"), F.col("l_orderkey").cast("string"))).alias("invoice_number"), _when("l_returnflag <> 'N'", _day("l_shipdate")).alias("invoice_date"), _when("l_returnflag <> 'R'", supplier).alias("supplier"),
        F.array(item).alias("line_items"), _when("l_tax > 0.02", F.col("l_extendedprice")).alias("subtotal"), _when("l_tax > 0.04", F.col("l_tax")).alias("tax"), _when("l_discount > 0.03", F.col("l_extendedprice")).alias("total"),
    ]
    part = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("doc_id"), part.alias("part"), F.struct(*fields).alias("extraction"))


def merged_invoices(spark: SparkSession, sf: str) -> DataFrame:
    whole = merging.audited(merging.merged(_invoices(spark, sf), "invoice"), "invoice")
    x = F.col("extraction")
    return whole.select(
        "doc_id", "parts", x["invoice_number"].alias("invoice_number"), x["invoice_date"].alias("invoice_date"), x["supplier"]["name"].alias("supplier_name"), x["supplier"]["tax_id"].alias("supplier_tax_id"), x["subtotal"].alias("subtotal"), x["tax"].alias("tax"), x["total"].alias("total"),
        F.array_join(F.transform(x["line_items"], lambda i: i["description"]), ",").alias("items"), F.col("warning.message").alias("message"),
    )


def merged_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """A receipt per user, a part per event."""
    value = F.col("value")
    fields = [
        _when("event_type = 'view'", "", F.col("event_type")).alias("merchant"), _when("event_type = 'click'", F.col("props")).alias("receipt_number"), _when("value > 30", _day("ts")).alias("date"),
        _when("event_type = 'purchase'", value).alias("subtotal"), _when("event_type = 'error'", value).alias("discount"), _when("event_type IN ('purchase', 'click')", value).alias("total"),
        F.array(F.struct(F.col("event_type").alias("description"), value.alias("total"))).alias("line_items"),
    ]
    parts = data.load(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("part"), F.struct(*fields).alias("extraction"))
    x = F.col("extraction")
    return merging.audited(merging.merged(parts, "receipt"), "receipt").select(
        "doc_id", "parts", x["merchant"].alias("merchant"), x["receipt_number"].alias("receipt_number"), x["date"].alias("date"), x["subtotal"].alias("subtotal"), x["discount"].alias("discount"), x["total"].alias("total"), F.size(x["line_items"]).cast("bigint").alias("n_items"), F.col("warning.message").alias("message")
    )


def merged_general(spark: SparkSession, sf: str) -> DataFrame:
    """A document per conversation, a part per turn; each role's latest length is a pair, each turn a table."""
    fields = [
        _when("role <> 'system'", F.substring("text", 1, 12)).alias("title"), F.substring("text", 1, 20).alias("summary"), F.create_map("role", F.length("text").cast("string")).alias("key_value_pairs"),
        F.array(F.array(F.array("role", F.col("turn").cast("string")))).alias("tables"),
    ]
    parts = data.load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), F.struct(*fields).alias("extraction"))
    x = F.col("extraction")
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(x["key_value_pairs"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    tables = F.array_join(F.transform(x["tables"], lambda t: F.array_join(t[0], ":")), ",")
    return merging.merged(parts, "general").select("doc_id", "parts", x["title"].alias("title"), x["summary"].alias("summary"), pairs.alias("pairs"), tables.alias("tables"))


QUERIES = (merged_statements, merged_statement_rows, merged_invoices, merged_receipts, merged_general)

_NUMBER = "regexp_replace(regexp_replace({}::DECIMAL(28,6)::VARCHAR, '0+$', ''), '\\.$', '.0')"
_CENTS = "round({}, 2)::DECIMAL(28,2)::VARCHAR"


def _first(value: str, order: str = "part", told: str = "{} <> ''") -> str:
    return f"arg_min({value}, {order}) FILTER ({told.format(value)})"


def _alone(column: str, value: str) -> str:
    """The part's own value where there is one part."""
    return f"CASE WHEN count(*) = 1 THEN min({column}) ELSE {value} END AS {column}"


_STATEMENT_PARTS = """WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_no, strftime(l_shipdate, '%Y-%m-%d') AS date,
  'Part ' || l_partkey AS description, l_returnflag AS reference, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS debit, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS credit FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
p AS (SELECT o_custkey AS doc_id, o_orderkey AS part, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN o_orderpriority END AS bank_name, CASE WHEN o_orderpriority > '3' THEN 'Holder ' || o_custkey END AS account_holder,
  CASE WHEN o_totalprice > 200000 THEN 'EUR' ELSE '' END AS currency, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS statement_period, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS opening_balance,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS closing_balance FROM orders)"""
_MISSED = "abs(round(expected, 2) - round({}::DECIMAL(28,6), 2)) > 0.05"
SQL = {
    "merged_statement_rows": f"{_STATEMENT_PARTS} SELECT doc_id, row_no, part, date, description, reference, debit, credit FROM r",
    "merged_statements": f"""{_STATEMENT_PARTS}, m AS (SELECT doc_id, count(*) AS parts, {', '.join(_alone(c, _first(c)) for c in ('bank_name', 'account_holder', 'currency', 'statement_period'))},
  arg_min(opening_balance, part) FILTER (opening_balance IS NOT NULL) AS opening_balance, arg_max(closing_balance, part) FILTER (closing_balance IS NOT NULL) AS closing_balance FROM p GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_rows, arg_min(description, row_no) AS first_row, arg_max(description, row_no) AS last_row, sum(coalesce(debit, 0)::DECIMAL(28,6)) AS debits, sum(coalesce(credit, 0)::DECIMAL(28,6)) AS credits FROM r GROUP BY doc_id),
e AS (SELECT m.*, coalesce(n_rows, 0) AS n_rows, first_row, last_row, debits, credits, opening_balance::DECIMAL(28,6) - debits + credits AS expected FROM m LEFT JOIN n ON n.doc_id = m.doc_id),
f AS (SELECT *, coalesce({_MISSED.format('closing_balance')}, FALSE) AS off FROM e)
SELECT doc_id, parts, bank_name, account_holder, currency, statement_period, opening_balance, closing_balance, n_rows, first_row, last_row, CASE WHEN off THEN 'FINANCIAL_ARITHMETIC_MISMATCH' END AS code,
  CASE WHEN off THEN 'Bank statement balance check mismatch: Opening (' || {_NUMBER.format('opening_balance')} || ') - Debits (' || {_CENTS.format('debits')} || ') + Credits (' || {_CENTS.format('credits')} || ') = ' || {_CENTS.format('expected')} ||
  ', but extracted closing balance is ' || {_NUMBER.format('round(closing_balance::DECIMAL(28,6), 2)')} || '.' END AS message FROM f""",
    "merged_invoices": f"""WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS part, CASE WHEN l_linestatus = 'O' THEN 'INV-' || l_orderkey END AS invoice_number,
  CASE WHEN l_returnflag <> 'N' THEN strftime(l_shipdate, '%Y-%m-%d') END AS invoice_date, CASE WHEN l_returnflag = 'A' THEN s_name WHEN l_returnflag <> 'R' THEN '' END AS supplier_name, CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN 'T' || l_suppkey END AS supplier_tax_id,
  CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS subtotal, CASE WHEN l_tax > 0.04 THEN l_tax END AS tax, CASE WHEN l_discount > 0.03 THEN l_extendedprice END AS total, l_partkey::VARCHAR AS item FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
m AS (SELECT doc_id, count(*) AS parts, {', '.join(_alone(c, _first(c)) for c in ('invoice_number', 'invoice_date', 'supplier_name', 'supplier_tax_id'))},
  {', '.join(f"arg_max({c}, part) FILTER ({c} IS NOT NULL) AS {c}" for c in ('subtotal', 'tax', 'total'))}, string_agg(item, ',' ORDER BY part) AS items FROM p GROUP BY doc_id),
e AS (SELECT *, subtotal::DECIMAL(28,6) + coalesce(tax, 0)::DECIMAL(28,6) AS expected FROM m)
SELECT * EXCLUDE (expected), CASE WHEN {_MISSED.format('total')} THEN 'Invoice total mismatch: Subtotal (' || {_NUMBER.format('subtotal')} || ') + Tax (' || {_NUMBER.format('coalesce(tax, 0)')} || ') = ' || {_CENTS.format('expected')} || ', but extracted total is ' || {_NUMBER.format('round(total::DECIMAL(28,6), 2)')} || '.' END AS message FROM e""",
    "merged_receipts": f"""WITH p AS (SELECT user_id AS doc_id, event_id AS part, CASE event_type WHEN 'view' THEN '' ELSE event_type END AS merchant, CASE event_type WHEN 'click' THEN props END AS receipt_number, CASE WHEN value > 30 THEN strftime(ts, '%Y-%m-%d') END AS date,
  CASE event_type WHEN 'purchase' THEN value END AS subtotal, CASE event_type WHEN 'error' THEN value END AS discount, CASE WHEN event_type IN ('purchase', 'click') THEN value END AS total FROM events),
m AS (SELECT doc_id, count(*) AS parts, {', '.join(_alone(c, _first(c)) for c in ('merchant', 'receipt_number', 'date'))}, {', '.join(f"arg_max({c}, part) FILTER ({c} IS NOT NULL) AS {c}" for c in ('subtotal', 'discount', 'total'))}, count(*) AS n_items FROM p GROUP BY doc_id),
e AS (SELECT *, subtotal::DECIMAL(28,6) - coalesce(discount, 0)::DECIMAL(28,6) AS expected FROM m)
SELECT * EXCLUDE (expected), CASE WHEN {_MISSED.format('total')} THEN 'Receipt total mismatch: Subtotal (' || {_NUMBER.format('subtotal')} || ') + Tax (0.0) - Discount (' || {_NUMBER.format('coalesce(discount, 0)')} || ') = ' || {_CENTS.format('expected')} || ', but extracted total is ' || {_NUMBER.format('round(total::DECIMAL(28,6), 2)')} || '.' END AS message FROM e""",
    "merged_general": f"""WITH p AS (SELECT conv_id AS doc_id, turn AS part, CASE WHEN role <> 'system' THEN left(text, 12) END AS title, left(text, 20) AS summary, role, length(text) AS n FROM conversations),
k AS (SELECT doc_id, string_agg(role || '=' || n, ',' ORDER BY role || '=' || n) AS pairs FROM (SELECT doc_id, role, arg_max(n, part) AS n FROM p GROUP BY doc_id, role) GROUP BY doc_id)
SELECT p.doc_id, count(*) AS parts, {_first('title')} AS title, string_agg(summary, chr(10) || chr(10) ORDER BY part) FILTER (summary <> '') AS summary, any_value(pairs) AS pairs, string_agg(role || ':' || part, ',' ORDER BY part) AS tables FROM p JOIN k ON k.doc_id = p.doc_id GROUP BY p.doc_id""",
}

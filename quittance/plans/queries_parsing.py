"""Queries of raw rows, currencies, misread amounts, date orders and e-invoice XML, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import currency
from ..operators import normalise
from ..sources import einvoice_xml
from . import driver_data as data


def _raw(spark, sf):
    """Bank rows as printed: debits and credits in columns, every third as one amount with a type, comma decimals in odd reconciliations."""
    b = data.bank(spark, sf)
    plain = F.col("amount").cast("decimal(28,2)").cast("string")
    printed = F.when(F.col("rec_id") % 2 == 1, F.replace(plain, F.lit("."), F.lit(","))).otherwise(plain)
    single = F.col("row_no") % 3 == 0
    of = lambda side: F.when(~single & (F.col("direction") == side), printed)
    day = F.when(F.col("rec_id") % 4 < 2, F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "MM/dd/yyyy"))
    return b.select(
        "rec_id", F.lit("bank").alias("source"), "row_no", day.alias("date"), "description", "reference", of("debit").alias("debit"), of("credit").alias("credit"),
        F.when(single, printed).alias("amount"), F.when(single, F.when(F.col("direction") == "debit", "Dr").otherwise("Deposit")).alias("type"), F.lit(None).cast("string").alias("balance"),
    )


def normalise_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _raw(spark, sf)
    typed = normalise.transactions(rows, normalise.locale(rows))
    return typed.select("rec_id", "id", "date", F.col("amount").cast("double").alias("amount"), "direction", "reference", F.array_join("tokens", " ").alias("desc_key"))


def document_locale(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.locale(_raw(spark, sf)).select("rec_id", "decimal_comma", "month_first")


def date_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers whose dates (days up to 12 only) show no order, read by their bank rows' dates."""
    bank = _raw(spark, sf)
    l = data.bank(spark, sf).where("day(date) <= 12")
    ledger = l.select("rec_id", F.lit("ledger").alias("source"), "row_no", F.date_format("date", "MM/dd/yyyy").alias("date"), *[F.lit(None).cast("string").alias(c) for c in ("description", "reference", "debit", "credit", "amount", "type", "balance")])
    rows = bank.unionByName(ledger)
    return normalise.date_orders(rows, normalise.locale(rows), bank.select("rec_id", F.lit("EUR").alias("currency")).distinct(), 0)


_PRINTED = {"CA$1,250": "CAD", "1 250,00 zł": "PLN", "Amount (GBP)": "GBP", "$500": None, "Particulars": None, "Rs 500": "INR", "€ 7": "EUR", "USD 12": "USD"}


def currency_detect(spark: SparkSession, sf: str) -> DataFrame:
    o = data.load(spark, sf, "orders")
    printed = F.element_at(F.array(*map(F.lit, _PRINTED)), (F.col("o_orderkey") % len(_PRINTED) + 1).cast("int"))
    return o.select("o_orderkey", printed.alias("printed")).select("o_orderkey", currency.currency_in(F.col("printed")).alias("currency"))


def _printed_pages(spark, sf):
    """Rows of 1,000 and more with `printed`, and their documents' printed text, a row for each page (10,000 row numbers of the bank)."""
    b = data.bank(spark, sf).where("amount >= 1000")
    whole, rest = F.floor(F.col("amount") / 1000), F.format_string("%06.2f", (F.col("amount") % 1000).cast("double"))
    printed = F.concat(whole.cast("string"), F.lit("."), F.replace(rest, F.lit("."), F.lit(",")))
    b = b.withColumn("printed", printed)
    pages = b.groupBy("rec_id", F.floor(F.col("row_no") / 10_000).alias("page")).agg(F.array_join(F.sort_array(F.collect_list("printed")), " und ").alias("raw_text"))
    return b, pages.select("rec_id", F.lit("bank").alias("source"), "raw_text")


def misread_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts whose group mark was read as the decimal point, mended from the printed text."""
    b, texts = _printed_pages(spark, sf)
    wrong = F.replace(F.replace("printed", F.lit(",")), F.lit(".")).try_cast("decimal(28,3)")
    values = b.select("rec_id", F.lit("bank").alias("source"), "row_no", F.lit("amount").alias("field"), wrong.alias("value"))
    return normalise.corrections(values, texts).select("rec_id", "row_no", F.col("corrected").cast("double").alias("corrected"))


def einvoice_xml_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as CII documents, parsed back."""
    li = data.load(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    item = F.struct(
        F.col("l_linenumber").cast("string").alias("position"), F.concat(F.lit("Part <"), F.col("l_partkey").cast("string"), F.lit(">")).alias("description"), text("l_quantity").alias("quantity"), F.lit("C62").alias("unit"),
        text("l_extendedprice").alias("net_price"), F.lit(None).cast("string").alias("price_base_quantity"), F.lit("S").alias("vat_category"), F.lit("19").alias("vat_rate"), text("l_extendedprice").alias("line_net_amount"),
    )
    none = F.lit(None).cast("string")
    invoices = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(item)).alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("string").alias("line_total")).select(
        "doc_id", F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("invoice_number"), F.lit("2026-01-05").alias("issue_date"), F.lit("380").alias("type_code"), F.lit("EUR").alias("currency"), none.alias("buyer_reference"),
        F.lit("Seller & Co").alias("seller_name"), F.lit("Buyer").alias("buyer_name"), F.lit("2026-02-05").alias("due_date"), none.alias("terms"), "lines", "line_total", F.col("line_total").alias("net_total"), none.alias("vat_total"), none.alias("gross_total"), none.alias("payable_amount"),
    )
    back = einvoice_xml.parse(einvoice_xml.to_cii(invoices))
    return back.select("doc_id", "syntax", "profile", "invoice_number", "issue_date", "due_date", "seller_name", F.size("lines").cast("bigint").alias("n_lines"), F.element_at("lines", 1)["description"].alias("first_line"), F.col("line_total").cast("double").alias("line_total"))


QUERIES = (normalise_rows, document_locale, date_order, currency_detect, misread_amounts, einvoice_xml_round_trip)

_STOP = "'the', 'to', 'from', 'by', 'for', 'and', 'of', 'a', 'an', 'in', 'on', 'at', 'ltd', 'pvt', 'inc'"
SQL = {
    "normalise_rows": f"WITH {data.BANK_SQL} SELECT rec_id, id, date, amount::DOUBLE AS amount, direction, reference, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+')))), ' ') AS desc_key FROM bank",
    "document_locale": f"WITH {data.BANK_SQL} SELECT rec_id, rec_id % 2 = 1 AS decimal_comma, rec_id % 4 >= 2 AS month_first FROM bank GROUP BY rec_id",
    "date_order": f"WITH {data.BANK_SQL} SELECT rec_id, rec_id % 4 >= 2 AS bank_month_first, TRUE AS ledger_month_first FROM bank WHERE day(date) <= 12 GROUP BY rec_id",
    "currency_detect": "SELECT o_orderkey, list_extract([" + ", ".join("NULL" if v is None else f"'{v}'" for v in _PRINTED.values()) + f"], CAST(o_orderkey % {len(_PRINTED)} AS INT) + 1) AS currency FROM orders",
    "einvoice_xml_round_trip": "SELECT l_orderkey AS doc_id, 'CII' AS syntax, 'EN 16931 (COMFORT)' AS profile, 'R' || l_orderkey AS invoice_number, '2026-01-05' AS issue_date, '2026-02-05' AS due_date, 'Seller & Co' AS seller_name, count(*) AS n_lines, arg_min('Part <' || l_partkey || '>', (l_linenumber::VARCHAR, 'Part <' || l_partkey || '>')) AS first_line, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS line_total FROM lineitem GROUP BY l_orderkey",
}

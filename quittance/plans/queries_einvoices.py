"""Queries of whole e-invoices: all orders with their customers and lines as CII and UBL documents, read back; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import einvoice_tree
from . import driver_data as data


def _invoices(spark, sf):
    """Every order with lines; the buyer is its customer, the seller the first line's supplier, an adjustment stands on some priorities."""
    none = F.lit(None).cast("string")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    off = F.round(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)"), 2).cast("decimal(18,2)").cast("string")
    adjusted = lambda amount, **more: F.struct(amount.alias("amount"), F.lit("Rebate & co").alias("reason"), none.alias("reason_code"), none.alias("base_amount"), none.alias("percent"), *[v.alias(k) for k, v in more.items()])
    empty = lambda x: F.filter(F.array(x), lambda _: F.lit(False))
    own = adjusted(off)
    category = F.when(F.col("l_returnflag") == "R", "E").otherwise("S")
    line = F.struct(
        F.col("l_linenumber").cast("string").alias("position"), none.alias("note"), F.concat(F.lit("Part <"), F.col("l_partkey").cast("string"), F.lit(">")).alias("description"), none.alias("item_description"), F.col("l_partkey").cast("string").alias("seller_article_number"),
        none.alias("buyer_article_number"), none.alias("gtin"), none.alias("gross_price"), money("l_extendedprice").alias("net_price"), none.alias("price_base_quantity"), money("l_quantity").alias("quantity"), F.lit("C62").alias("unit"), category.alias("vat_category"), F.lit("0").alias("vat_rate"),
        money("l_extendedprice").alias("line_net_amount"), F.when(F.col("l_discount") > 0, F.array(own)).otherwise(empty(own)).alias("allowances"), empty(own).alias("charges"),
    )
    li = data.load(spark, sf, "lineitem").withColumns({"line": line, "category": category})
    groups = li.groupBy("l_orderkey", "category").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("string").alias("basis")).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("category", F.lit("0").alias("rate"), F.col("basis").alias("basis_amount"), F.lit("0.00").alias("tax_amount"), F.when(F.col("category") == "E", "none due").alias("exemption_reason"), none.alias("exemption_reason_code")))).alias("vat_breakdown")
    )
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.min("l_suppkey").alias("suppkey")).join(groups, "l_orderkey")
    o = data.load(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(data.load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    address = lambda city, country, street=none: F.struct(street.alias("street"), none.alias("additional_street"), none.alias("address_line_3"), none.alias("postcode"), city.alias("city"), country.alias("country"), none.alias("country_subdivision"))
    contact = F.struct(F.col("c_name").alias("name"), none.alias("phone"), none.alias("email"))
    supplier = F.col("suppkey").cast("string")
    seller = F.struct(supplier.alias("id"), none.alias("global_id"), F.concat(F.lit("Seller "), supplier).alias("name"), address(F.lit("Wien"), F.lit("AT"), F.lit("Road 1 & 2")).alias("address"), F.concat(F.lit("ATU"), supplier).alias("vat_id"), F.lit("s@example.com").alias("electronic_address"), F.lit("EM").alias("electronic_address_scheme"), F.lit(None).cast("struct<name: string, phone: string, email: string>").alias("contact"), none.alias("tax_number"), none.alias("trading_name"), F.struct(F.concat(F.lit("FN"), supplier).alias("commercial_register"), none.alias("additional_info")).alias("legal"))
    buyer = F.struct(F.col("o_custkey").cast("string").alias("id"), none.alias("global_id"), F.col("c_name").alias("name"), address(F.col("c_mktsegment"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("address"), none.alias("vat_id"), none.alias("electronic_address"), none.alias("electronic_address_scheme"), contact.alias("contact"), F.col("o_orderpriority").alias("buyer_reference"), none.alias("legal_registration_id"))
    whole = adjusted(F.lit("2.50"), vat_category=F.lit("S"), vat_rate=F.lit("0"))
    on = lambda priority: F.when(F.col("o_orderpriority").startswith(priority), F.array(whole)).otherwise(empty(whole))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    none_of = dict.fromkeys(("line_total", "charges", "allowances", "net_total", "vat_total", "gross_total", "prepaid_amount", "rounding_amount"), none)
    totals = F.struct(*[c.alias(n) for n, c in (none_of | {"vat_total": F.lit("0.00"), "payable_amount": money("o_totalprice")}).items()])
    paid = F.struct(F.lit("58").alias("means_code"), F.lit("DE89370400440532013000").alias("iban"), *[none.alias(n) for n in ("account_name", "bic", "debtor_iban", "payment_reference", "mandate_reference", "creditor_id")], day.alias("due_date"), F.col("o_orderpriority").alias("terms"), F.when(F.col("o_orderstatus") == "F", 7).cast("int").alias("discount_days"), F.when(F.col("o_orderstatus") == "F", "2.00").alias("discount_percent"))
    fields = {
        "invoice_number": F.concat(F.lit("R"), F.col("o_orderkey").cast("string")), "issue_date": day, "type_code": F.when(F.col("o_orderstatus") == "P", "381").otherwise("380"), "currency": F.lit("EUR"), "notes": F.array("o_orderstatus", "o_orderpriority"), "seller": seller, "buyer": buyer, "lines": F.col("lines"),
        "allowances": on("1"), "charges": on("2"), "vat_breakdown": F.col("vat_breakdown"), "totals": totals, "payment": paid, "delivery_address": address(F.col("c_mktsegment"), F.lit("DE")),
    }
    return o.select(F.col("o_orderkey").alias("doc_id"), *[fields.get(n, none).alias(n) for n in einvoice_tree.FIELDS])


def einvoice_tree_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """CII for even orders, UBL for odd ones."""
    xml = F.when(F.col("doc_id") % 2 == 0, einvoice_tree.cii()).when(F.col("doc_id") % 2 == 1, einvoice_tree.ubl())
    back = einvoice_tree.parse(_invoices(spark, sf).select("doc_id", xml.alias("xml")))
    groups = F.array_join(F.transform("vat_breakdown", lambda g: F.concat_ws(":", g["category"], g["basis_amount"], g["exemption_reason"])), ";")
    off = F.aggregate(F.flatten(F.transform("lines", lambda x: x["allowances"])), F.lit(0).cast("decimal(38,2)"), lambda s, a: (s + a["amount"].cast("decimal(18,2)")).cast("decimal(38,2)"))
    return back.select(
        "doc_id", "syntax", "invoice_number", "issue_date", "type_code", F.array_join("notes", "|").alias("notes"), F.col("seller.id").alias("seller_id"), F.col("seller.vat_id").alias("seller_vat_id"), F.col("seller.legal.commercial_register").alias("register"), F.col("seller.address.street").alias("seller_street"),
        F.col("buyer.name").alias("buyer_name"), F.col("buyer.address.city").alias("buyer_city"), F.col("buyer.address.country").alias("buyer_country"), F.col("buyer.contact.name").alias("buyer_contact"), F.col("buyer.buyer_reference").alias("buyer_reference"), F.col("delivery_address.country").alias("delivery_country"),
        F.size("lines").cast("bigint").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["description"]), ",").alias("parts"), off.cast("double").alias("line_allowances"), F.size("allowances").cast("bigint").alias("n_allowances"), F.size("charges").cast("bigint").alias("n_charges"), groups.alias("vat_groups"),
        F.col("totals.payable_amount").cast("double").alias("payable"), F.col("payment.due_date").alias("due_date"), F.col("payment.terms").alias("terms"), F.col("payment.discount_days").cast("bigint").alias("discount_days"),
    )


QUERIES = (einvoice_tree_round_trip,)

SQL = {
    "einvoice_tree_round_trip": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n_lines, min(l_suppkey) AS s, string_agg('Part <' || l_partkey || '>', ',' ORDER BY l_linenumber::VARCHAR, 'Part <' || l_partkey || '>', l_partkey::VARCHAR, l_extendedprice::DECIMAL(18,2)::VARCHAR) AS parts,
  coalesce(sum(round(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2), 2)::DECIMAL(18,2)), 0)::DOUBLE AS line_allowances FROM lineitem GROUP BY l_orderkey),
g AS (SELECT k, string_agg(c || ':' || b || CASE WHEN c = 'E' THEN ':none due' ELSE '' END, ';' ORDER BY c) AS vat_groups FROM (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 'E' ELSE 'S' END AS c, sum(l_extendedprice::DECIMAL(18,2))::VARCHAR AS b FROM lineitem GROUP BY ALL) GROUP BY k)
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CII' ELSE 'UBL' END AS syntax, 'R' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS issue_date, CASE o_orderstatus WHEN 'P' THEN '381' ELSE '380' END AS type_code, o_orderstatus || '|' || o_orderpriority AS notes,
  s::VARCHAR AS seller_id, 'ATU' || s AS seller_vat_id, 'FN' || s AS register, 'Road 1 & 2' AS seller_street, c_name AS buyer_name, c_mktsegment AS buyer_city, 'N' || c_nationkey AS buyer_country, c_name AS buyer_contact, o_orderpriority AS buyer_reference, 'DE' AS delivery_country, n_lines, parts, line_allowances,
  (o_orderpriority LIKE '1%')::BIGINT AS n_allowances, (o_orderpriority LIKE '2%')::BIGINT AS n_charges, vat_groups, o_totalprice::DECIMAL(18,2)::DOUBLE AS payable, strftime(o_orderdate, '%Y-%m-%d') AS due_date, o_orderpriority AS terms, CASE o_orderstatus WHEN 'F' THEN 7 END::BIGINT AS discount_days
FROM orders JOIN l ON l.k = o_orderkey JOIN g ON g.k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""",
}

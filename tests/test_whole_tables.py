"""Queries that left rows or rules out, over whole tables and against the whole rules."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quittance import catalog
from quittance.operators import einvoice
from quittance.plans import driver_data, queries_documents

SF = "/root/testdata/sf0.001"


def test_all_orders_go_through_xml(spark):
    orders = driver_data.load(spark, SF, "lineitem").select("l_orderkey").distinct().count()
    assert catalog.queries()["einvoice_xml_round_trip"](spark, SF).count() == orders


def test_all_misread_amounts_are_mended(spark):
    want = {(r["rec_id"], r["row_no"], float(r["amount"])) for r in driver_data.bank(spark, SF).where("amount >= 1000").collect()}
    assert want and {tuple(r) for r in catalog.queries()["misread_amounts"](spark, SF).collect()} == want


def test_header_rules_of_xrechnung(spark):
    _, breakdown, _, totals = queries_documents._computed(spark, SF)
    base = queries_documents._headers(breakdown, totals).limit(1).withColumn("categories", F.array(F.lit("S")))
    row = base.first().asDict()
    assert einvoice.header_issues(base).count() == 0
    gone = lambda *names: {n: None for n in names}
    cases = [
        ({"categories": ["K"], **gone("delivery_street", "delivery_postcode", "delivery_city", "delivery_country")}, {("BR-IC-12", "error")}),
        ({"buyer_reference": "04011000-1234512345-07"}, {("LEITWEG-ID", "error")}),
        ({"buyer_reference": "abc"}, {("LEITWEG-ID", "warning")}),
        (gone("seller_contact_name", "seller_contact_phone", "seller_contact_email"), {("BR-DE-2", "error")}),
        (gone("seller_contact_phone"), {("BR-DE-6", "error")}),
        (gone("seller_contact_email"), {("BR-DE-7", "error")}),
        (gone("seller_electronic_address"), {("PEPPOL-EN16931-R020", "error")}),
        (gone("buyer_electronic_address"), {("PEPPOL-EN16931-R010", "error")}),
        (gone("delivery_city"), {("BR-DE-10", "error")}),
        (gone("delivery_postcode"), {("BR-DE-11", "error")}),
        ({**gone("means_code", "iban", "terms", "mandate_reference", "creditor_id", "debtor_iban", "due_date"), "payable_amount": None}, {("BR-DE-1", "error")}),
        ({"means_code": "59", **gone("creditor_id", "debtor_iban")}, {("BR-DE-30", "error"), ("BR-DE-31", "error")}),
        ({"means_code": "54"}, {("BR-DE-24-a", "error")}),
    ]
    headers = spark.createDataFrame([{**row, **change, "inv_id": i} for i, (change, _) in enumerate(cases)], StructType([StructField(f.name, f.dataType) for f in base.schema]))
    got = {(r["inv_id"], r["rule_id"], r["severity"]) for r in einvoice.header_issues(headers).collect()}
    assert got == {(i, *issue) for i, (_, want) in enumerate(cases) for issue in want}
    entries = spark.createDataFrame([(0, "charges[0]", 5, 50, 10), (1, "lines[2].allowances[0]", 6, 50, 10), (2, "allowances[1]", 6, None, 10)], "inv_id long, path string, amount int, base_amount int, percent int")
    got = [tuple(r) for r in einvoice.percent_issues(entries, headers).collect()]
    assert got == [(1, "PEPPOL-EN16931-R040", "lines[2].allowances[0].amount", "error", "5.00", "6.00")]

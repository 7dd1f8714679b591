"""Raw rows to typed ones, currencies, misread amounts, e-invoice XML."""

from decimal import Decimal

from pyspark.sql import functions as F

from quittance.functions import currency
from quittance.operators import normalise
from quittance.sources import einvoice_xml

RAW = "rec_id long, source string, row_no long, date string, description string, reference string, debit string, credit string, amount string, type string, balance string"


def test_sides(spark):
    data = [
        (1, "bank", 1, "01/02/2026", "Dep", None, None, None, "10.00", "Deposit", None), (1, "bank", 2, "13/02/2026", "Chk", "in-1", None, None, "20.00", "Check", None),
        (1, "bank", 3, None, "x", None, None, None, "-75.00", "Deposit", None), (1, "bank", 4, "x", "y", None, None, None, "60.00 CR", None, "200.00 Dr"),
        (1, "bank", 5, "1/2/2026", "both", None, "5.00", "7.50", None, None, None), (1, "bank", 6, "1/2/2026", "zero blocks", None, "0", None, "9.00", None, None),
        (2, "ledger", 1, "10/13/2026", "comma", None, "1.234,56", None, None, None, None),
    ]
    rows = spark.createDataFrame(data, RAW)
    got = {(r["rec_id"], r["row_no"]): r for r in normalise.transactions(rows, normalise.locale(rows)).collect()}
    assert {k: (r["direction"], float(r["amount"])) for k, r in got.items()} == {(1, 1): ("credit", 10), (1, 2): ("debit", 20), (1, 3): ("debit", 75), (1, 4): ("credit", 60), (1, 5): ("credit", 2.5), (2, 1): ("debit", 1234.56)}
    assert str(got[1, 1]["date"]) == "2026-02-01" and str(got[2, 1]["date"]) == "2026-10-13" and got[1, 4]["balance"] == Decimal("-200") and got[1, 2]["reference"] == "IN1"


def test_date_orders(spark):
    bank = [(1, "bank", i, d, "", None, None, "1", None, None, None) for i, d in enumerate(["13/02/2026", "05/03/2026", "06/03/2026"])]
    ledger = [(1, "ledger", i, d, "", None, None, "1", None, None, None) for i, d in enumerate(["03/05/2026", "03/06/2026"])]
    rows = spark.createDataFrame(bank + ledger, RAW)
    got = normalise.date_orders(rows, normalise.locale(rows), spark.createDataFrame([(1, "EUR")], "rec_id long, currency string")).first()
    assert (got["bank_month_first"], got["ledger_month_first"]) == (False, True)


def test_currencies(spark):
    values = ["usd", "CA$", "zł", "Rs.", "$", "xx", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(currency.normal_currency(F.col("v"))).collect()] == ["USD", "CAD", "PLN", "INR", None, None, None]
    printed = ["CA$1,250", "1 250,00 zł", "Amount (GBP)", "$500", "Particulars", "Rs 500"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(printed)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(currency.currency_in(F.col("v"))).collect()] == ["CAD", "PLN", "GBP", None, None, "INR"]
    heads = spark.createDataFrame([(1, "bank", "INR"), (1, "ledger", "USD"), (2, "bank", "$"), (2, "ledger", "CAD"), (3, "bank", None), (3, "ledger", None)], "rec_id long, source string, currency string")
    assert {r["rec_id"]: (r["currency"], r["issue"]) for r in normalise.bound_currencies(heads).collect()} == {1: (None, "currencies_differ"), 2: ("CAD", "shared_symbol"), 3: (None, "no_currency")}


def test_misread(spark):
    text = "Saldo 1.234,56 am 01.02.2026 und 2.500,00 sowie 99,10 und 7.777,70"
    values = [(1, "bank", 1, "debit", Decimal("1.23")), (1, "bank", 2, "debit", Decimal("-250000")), (1, "bank", 3, "debit", Decimal("99.10")), (1, "bank", 4, "debit", Decimal("5"))]
    got = normalise.corrections(spark.createDataFrame(values, "rec_id long, source string, row_no long, field string, value decimal(28,3)"), spark.createDataFrame([(1, "bank", text)], "rec_id long, source string, raw_text string"))
    assert sorted((r["row_no"], float(r["corrected"])) for r in got.collect()) == [(1, 1234.56), (2, -2500.0)]


def test_xml_round_trip(spark):
    line = ("1", "Wheel & axle <b>", "2", "HUR", "10.50", None, "S", "19", "21.00")
    schema = "doc_id long, syntax string, profile string, version string, invoice_number string, issue_date string, type_code string, currency string, buyer_reference string, seller_name string, buyer_name string, due_date string, terms string, iban string, lines array<struct<position:string,description:string,quantity:string,unit:string,net_price:string,price_base_quantity:string,vat_category:string,vat_rate:string,line_net_amount:string>>, line_total string, net_total string, vat_total string, gross_total string, payable_amount string"
    invoices = spark.createDataFrame([(1, "CII", "EN 16931 (COMFORT)", None, "R-1", "2026-01-05", "380", "EUR", "ref", "Seller", "Buyer", "2026-02-05", "30 days", None, [line], "21.00", "21.00", "3.99", "24.99", "24.99")], schema)
    back = einvoice_xml.parse(einvoice_xml.to_cii(invoices)).select(*invoices.columns)
    assert back.first().asDict(True) == invoices.first().asDict(True)
    bad = spark.createDataFrame([(1, "<!DOCTYPE x><Invoice/>"), (2, "not xml"), (3, None)], "doc_id long, xml string")
    assert all(r["invoice_number"] is None for r in einvoice_xml.parse(bad).collect())
    ubl = '<?xml version="1.0"?><ubl:Invoice xmlns:ubl="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2" xmlns:cbc="urn:c" xmlns:cac="urn:a"><cbc:CustomizationID>urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0</cbc:CustomizationID><cbc:ID>U1</cbc:ID><cac:InvoiceLine><cbc:ID>1</cbc:ID><cbc:InvoicedQuantity unitCode="KGM">3</cbc:InvoicedQuantity><cac:Item><cbc:Name>Nail</cbc:Name></cac:Item></cac:InvoiceLine></ubl:Invoice>'
    got = einvoice_xml.parse(spark.createDataFrame([(1, ubl)], "doc_id long, xml string")).first()
    assert (got["syntax"], got["profile"], got["version"], got["invoice_number"], got["lines"][0]["unit"], got["lines"][0]["description"]) == ("UBL", "XRECHNUNG", "3.0", "U1", "KGM", "Nail")
    terms = spark.createDataFrame([("Pay soon\n#SKONTO#TAGE=7#PROZENT=2.00#\nThanks",), ("plain",)], "t string").select(einvoice_xml.payment_terms(F.col("t")).alias("p")).collect()
    assert tuple(terms[0]["p"]) == ("Pay soon\nThanks", 7, "2.00") and tuple(terms[1]["p"]) == ("plain", None, None)

"""Whole invoices through both syntaxes and back, and documents of others."""

import copy

from quittance.sources import einvoice_tree as tree

ADDRESS = {"street": "Main <1>", "additional_street": "Door 2", "address_line_3": "c/o A & B", "postcode": "10115", "city": "Berlin", "country": "DE", "country_subdivision": "BE"}
NOWHERE = dict.fromkeys(ADDRESS)
ADJUSTED = {"amount": "2.50", "reason": "Rebate", "reason_code": "95", "base_amount": "25.00", "percent": "10"}
LINE = {
    "position": "1", "note": "careful", "description": "Wheel & axle", "item_description": "round", "seller_article_number": "S1", "buyer_article_number": "B1", "gtin": "4012345678901", "gross_price": "11.00", "net_price": "10.50", "price_base_quantity": "1",
    "quantity": "2", "unit": "HUR", "vat_category": "S", "vat_rate": "19", "line_net_amount": "21.00", "allowances": [ADJUSTED, {**ADJUSTED, "amount": "1.00"}], "charges": [{**ADJUSTED, "reason": None}],
}
CONTACT = {"name": "Jo", "phone": "030 1", "email": "jo@example.com"}
WHOLE = {
    "invoice_number": "R-1", "issue_date": "2026-01-05", "type_code": "380", "currency": "EUR", "delivery_date": "2026-01-04", "delivery_name": "Store", "delivery_address": ADDRESS, "billing_period_start": "2026-01-01", "billing_period_end": "2026-01-31",
    "order_reference": "O-7", "contract_reference": "C-7", "preceding_invoice_number": "R-0", "preceding_invoice_date": "2025-12-05", "notes": ["First", "Second & last"],
    "seller": {"id": "77", "global_id": "4000001123452", "name": "Seller", "address": ADDRESS, "vat_id": "DE123456789", "electronic_address": "s@example.com", "electronic_address_scheme": "EM", "contact": CONTACT, "tax_number": "12/345", "trading_name": "Shop", "legal": {"commercial_register": "HRB 1", "additional_info": "Ltd"}},
    "buyer": {"id": "88", "global_id": None, "name": "Buyer", "address": {**NOWHERE, "country": "AT"}, "vat_id": None, "electronic_address": "b", "electronic_address_scheme": "0204", "contact": None, "buyer_reference": "0401", "legal_registration_id": "FN 2"},
    "lines": [LINE, {**dict.fromkeys(LINE), "position": "2", "unit": "C62", "vat_category": "Z", "vat_rate": "0", "quantity": "1", "allowances": [], "charges": []}],
    "allowances": [{**ADJUSTED, "vat_category": "S", "vat_rate": "19"}], "charges": [{**ADJUSTED, "vat_category": "E", "vat_rate": "0"}] * 2,
    "vat_breakdown": [{"category": "S", "rate": "19", "basis_amount": "21.00", "tax_amount": "3.99", "exemption_reason": None, "exemption_reason_code": None}, {"category": "E", "rate": "0", "basis_amount": "5.00", "tax_amount": "0.00", "exemption_reason": "none due", "exemption_reason_code": "VATEX-EU-132"}],
    "totals": {"line_total": "21.00", "charges": "5.00", "allowances": "2.50", "net_total": "23.50", "vat_total": "3.99", "gross_total": "27.49", "prepaid_amount": "1.00", "rounding_amount": "0.01", "payable_amount": "26.50"},
    "payment": {"means_code": "59", "iban": "DE89370400440532013000", "account_name": "Seller", "bic": "COBADEFFXXX", "debtor_iban": "AT611904300234573201", "payment_reference": "Ref", "mandate_reference": "M1", "creditor_id": "DE98ZZZ09999999999", "due_date": "2026-02-05", "terms": "30 days\nnet", "discount_days": 7, "discount_percent": "2.00"},
}


def schema(spark):
    empty = spark.createDataFrame([], "doc_id long, xml string")
    return tree.parse(empty).drop("syntax").schema


def test_round_trips(spark):
    bare = dict.fromkeys(WHOLE) | {"invoice_number": "R-2", "type_code": "381", "currency": "USD", "notes": [], "lines": [LINE], "allowances": [], "charges": [], "vat_breakdown": [], "totals": dict.fromkeys(WHOLE["totals"]) | {"payable_amount": "3"}}
    free = copy.deepcopy(WHOLE) | {"payment": dict.fromkeys(WHOLE["payment"]) | {"means_code": "1", "terms": "soon"}}
    rows = [{"doc_id": k} | r for k, r in enumerate((WHOLE, bare, free))]
    invoices = spark.createDataFrame(rows, schema(spark))
    for syntax, write in (("CII", tree.to_cii), ("UBL", tree.to_ubl)):
        back = {r["doc_id"]: r.asDict(True) for r in tree.parse(write(invoices)).collect()}
        for r in rows:
            got = back[r["doc_id"]]
            assert got.pop("syntax") == syntax
            assert got == r, {k: (got[k], r[k]) for k in r if got[k] != r[k]}


def test_documents_of_others(spark):
    ubl = (
        '<?xml version="1.0"?><Invoice xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2" xmlns:cbc="urn:c" xmlns:cac="urn:a"><cbc:ID> U1 </cbc:ID><cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode><cac:PayeeParty><cac:PartyIdentification><cbc:ID schemeID="SEPA">PAYEE</cbc:ID></cac:PartyIdentification></cac:PayeeParty>'
        '<cac:AccountingSupplierParty><cac:Party><cac:PartyIdentification><cbc:ID schemeID="SEPA">SUP</cbc:ID></cac:PartyIdentification><cac:PartyIdentification><cbc:ID>first</cbc:ID></cac:PartyIdentification><cac:PartyIdentification><cbc:ID>second</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>Known as</cbc:Name></cac:PartyName>'
        '<cac:PartyTaxScheme><cbc:CompanyID>ATU1</cbc:CompanyID><cac:TaxScheme><cbc:ID>VAT</cbc:ID></cac:TaxScheme></cac:PartyTaxScheme><cac:PartyTaxScheme><cbc:CompanyID>99</cbc:CompanyID></cac:PartyTaxScheme></cac:Party></cac:AccountingSupplierParty>'
        '<cac:PaymentMeans><cac:PayeeFinancialAccount><cbc:ID>AT1</cbc:ID></cac:PayeeFinancialAccount><cbc:PaymentDueDate>2026-03-01</cbc:PaymentDueDate></cac:PaymentMeans><cac:TaxTotal><cbc:TaxAmount currencyID="USD">9</cbc:TaxAmount></cac:TaxTotal><cac:TaxTotal><cbc:TaxAmount currencyID="EUR">8</cbc:TaxAmount></cac:TaxTotal></Invoice>'
    )
    rows = [(1, ubl), (2, "<!DOCTYPE x><Invoice/>"), (3, "no xml"), (4, None), (5, '<CrossIndustryInvoice><SupplyChainTradeTransaction/></CrossIndustryInvoice>'), (6, ubl[:-40])]
    got = {r["doc_id"]: r.asDict(True) for r in tree.parse(spark.createDataFrame(rows, "doc_id long, xml string")).collect()}
    u = got[1]
    assert (u["invoice_number"], u["seller"]["id"], u["seller"]["name"], u["seller"]["trading_name"], u["seller"]["vat_id"], u["seller"]["tax_number"], u["seller"]["address"]) == ("U1", "first", "Known as", None, "ATU1", "99", NOWHERE)
    assert (u["buyer"], u["payment"]["means_code"], u["payment"]["creditor_id"], u["payment"]["due_date"], u["totals"]["vat_total"], u["lines"]) == (None, "1", "PAYEE", "2026-03-01", "8", [])
    assert all(got[k]["invoice_number"] is None for k in (2, 3, 4, 5, 6)) and got[5]["syntax"] == "CII" and got[5]["lines"] == []


def test_texts_are_made_once(spark):
    """The text of a value stands once in a document's expression, however deep its element lies: three replacements each."""
    for document in (tree.cii(), tree.ubl()):
        assert 300 < document._jc.toString().count("replace(") < 700


def test_document_with_prefixes_in_text(spark):
    """What looks like an element inside of CDATA is text; instructions and comments are passed over."""
    ns = 'xmlns:rsm="b" xmlns:ram="a"'
    xml = f'﻿<?xml version="1.0"?><!-- <b:z> --><rsm:CrossIndustryInvoice {ns}><rsm:ExchangedDocument><?pi in side?><ram:ID><![CDATA[U<b:c>]]></ram:ID></rsm:ExchangedDocument></rsm:CrossIndustryInvoice>'
    got = tree.parse(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).first()
    assert (got["syntax"], got["invoice_number"]) == ("CII", "U<b:c>")

"""E-invoice XML (CII and UBL) to columns and back.

Spark's own XML parser reads a document once with a nested schema, and drops prefixes. Documents
with a DOCTYPE or ENTITY declaration are refused before parsing; malformed ones give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: specification identifier: profile (fixed values)
PROFILES = {
    "urn:factur-x.eu:1p0:minimum": "MINIMUM", "urn:factur-x.eu:1p0:basicwl": "BASIC WL", "urn:cen.eu:en16931:2017#compliant#urn:factur-x.eu:1p0:basic": "BASIC", "urn:cen.eu:en16931:2017": "EN 16931 (COMFORT)",
    "urn:cen.eu:en16931:2017#conformant#urn:factur-x.eu:1p0:extended": "EXTENDED", "urn:zugferd.de:2p0:minimum": "MINIMUM", "urn:zugferd.de:2p0:basicwl": "BASIC WL",
    "urn:cen.eu:en16931:2017#compliant#urn:zugferd.de:2p0:basic": "BASIC", "urn:cen.eu:en16931:2017#conformant#urn:zugferd.de:2p0:extended": "EXTENDED",
    "urn:cen.eu:en16931:2017#compliant#urn:fdc:peppol.eu:2017:poacc:billing:3.0": "PEPPOL BIS 3.0", "urn:ferd:CrossIndustryDocument:invoice:1p0:basic": "ZUGFeRD 1.0 BASIC",
    "urn:ferd:CrossIndustryDocument:invoice:1p0:comfort": "ZUGFeRD 1.0 COMFORT", "urn:ferd:CrossIndustryDocument:invoice:1p0:extended": "ZUGFeRD 1.0 EXTENDED",
}
XRECHNUNG = r"urn:(?:xeinkauf\.de:kosit|xoev-de:kosit:standard):xrechnung_([0-9]+(?:\.[0-9]+)*)"
_VALUED = "STRUCT<_VALUE: STRING, {attribute}: STRING>"
_ADJUST = "STRUCT<ChargeIndicator: STRUCT<Indicator: STRING>, ActualAmount: STRING, Reason: STRING, BasisAmount: STRING, CalculationPercent: STRING, CategoryTradeTax: STRUCT<CategoryCode: STRING, RateApplicablePercent: STRING>>"
_PARTY = "STRUCT<ID: STRING, Name: STRING, DefinedTradeContact: STRUCT<PersonName: STRING>, PostalTradeAddress: STRUCT<PostcodeCode: STRING, LineOne: STRING, CityName: STRING, CountryID: STRING>, SpecifiedTaxRegistration: ARRAY<STRUCT<ID: STRUCT<_VALUE: STRING, _schemeID: STRING>>>>"
_DATE = "STRUCT<DateTimeString: STRING>"
CII = f"""ExchangedDocumentContext STRUCT<GuidelineSpecifiedDocumentContextParameter: STRUCT<ID: STRING>>,
ExchangedDocument STRUCT<ID: STRING, TypeCode: STRING, IssueDateTime: {_DATE}>,
SupplyChainTradeTransaction STRUCT<
  IncludedSupplyChainTradeLineItem: ARRAY<STRUCT<AssociatedDocumentLineDocument: STRUCT<LineID: STRING>, SpecifiedTradeProduct: STRUCT<Name: STRING>,
    SpecifiedLineTradeAgreement: STRUCT<NetPriceProductTradePrice: STRUCT<ChargeAmount: STRING, BasisQuantity: STRING>>,
    SpecifiedLineTradeDelivery: STRUCT<BilledQuantity: {_VALUED.format(attribute='_unitCode')}>,
    SpecifiedLineTradeSettlement: STRUCT<ApplicableTradeTax: STRUCT<CategoryCode: STRING, RateApplicablePercent: STRING>, SpecifiedTradeAllowanceCharge: ARRAY<{_ADJUST}>,
      SpecifiedTradeSettlementLineMonetarySummation: STRUCT<LineTotalAmount: STRING>>>>,
  ApplicableHeaderTradeAgreement: STRUCT<BuyerReference: STRING, SellerTradeParty: {_PARTY}, BuyerTradeParty: {_PARTY}>,
  ApplicableHeaderTradeDelivery: STRUCT<ActualDeliverySupplyChainEvent: STRUCT<OccurrenceDateTime: {_DATE}>>,
  ApplicableHeaderTradeSettlement: STRUCT<InvoiceCurrencyCode: STRING, SpecifiedTradeSettlementPaymentMeans: STRUCT<TypeCode: STRING, PayeePartyCreditorFinancialAccount: STRUCT<IBANID: STRING>>,
    SpecifiedTradePaymentTerms: STRUCT<Description: STRING, DueDateDateTime: {_DATE}>, SpecifiedTradeAllowanceCharge: ARRAY<{_ADJUST}>,
    ApplicableTradeTax: ARRAY<STRUCT<CategoryCode: STRING, RateApplicablePercent: STRING, BasisAmount: STRING, CalculatedAmount: STRING, ExemptionReason: STRING>>,
    SpecifiedTradeSettlementHeaderMonetarySummation: STRUCT<LineTotalAmount: STRING, AllowanceTotalAmount: STRING, ChargeTotalAmount: STRING, TaxBasisTotalAmount: STRING,
      TaxTotalAmount: ARRAY<{_VALUED.format(attribute='_currencyID')}>, GrandTotalAmount: STRING, TotalPrepaidAmount: STRING, DuePayableAmount: STRING>>>"""
_MONEY = _VALUED.format(attribute="_currencyID")
_LINE = f"STRUCT<ID: STRING, InvoicedQuantity: {_VALUED.format(attribute='_unitCode')}, CreditedQuantity: {_VALUED.format(attribute='_unitCode')}, LineExtensionAmount: {_MONEY}, Item: STRUCT<Name: STRING, ClassifiedTaxCategory: STRUCT<ID: STRING, Percent: STRING>>, Price: STRUCT<PriceAmount: {_MONEY}, BaseQuantity: {_VALUED.format(attribute='_unitCode')}>>"
UBL = f"""CustomizationID STRING, ID STRING, IssueDate STRING, DueDate STRING, InvoiceTypeCode STRING, CreditNoteTypeCode STRING, DocumentCurrencyCode STRING, BuyerReference STRING,
InvoiceLine ARRAY<{_LINE}>, CreditNoteLine ARRAY<{_LINE}>,
LegalMonetaryTotal STRUCT<LineExtensionAmount: {_MONEY}, TaxExclusiveAmount: {_MONEY}, TaxInclusiveAmount: {_MONEY}, PayableAmount: {_MONEY}>"""


#: Spark's parser drops prefixes by itself
OPTIONS = {"ignoreNamespace": "true"}


def safe(xml: Column) -> Column:
    """Whether a document looks like XML and declares no types or entities."""
    start = F.ltrim(F.when(xml.startswith("\ufeff"), F.substring(xml, 2, 2**31 - 1)).otherwise(xml))
    return start.startswith("<") & ~(xml.contains("<!") & F.upper(xml).rlike("<!DOCTYPE|<!ENTITY"))


def _bare(xml: Column) -> Column:
    """A safe document without what stands before its root; later instructions are passed over by the parser."""
    return F.when(safe(xml), F.regexp_replace(xml, r"^(\uFEFF?)\s*(?:<\?[^>]*\?>\s*)*", "$1"))


def syntax_of(xml: Column) -> Column:
    """CII, UBL, ZUGFeRD-1.0 or UNKNOWN by the root element and its namespace."""
    # plain searches first: a pattern that is not there would be tried at every character
    root = lambda name: xml.contains(name) & xml.rlike(rf"<(\w+:)?{name}[\s>]")
    urn = "urn:oasis:names:specification:ubl:schema:xsd:"
    return (
        F.when(root("CrossIndustryInvoice"), "CII")
        .when(root("CrossIndustryDocument"), "ZUGFeRD-1.0")
        .when(xml.contains(urn) & xml.rlike(rf"<(\w+:)?(Invoice|CreditNote)\s[^>]*{urn}(Invoice|CreditNote)-2"), "UBL")
        .otherwise("UNKNOWN")
    )


def profile_of(urn: Column) -> Column:
    u = F.trim(F.coalesce(urn, F.lit("")))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv]), u)
    return F.when(u.rlike(XRECHNUNG), "XRECHNUNG").when(known.isNotNull(), known).when(u.startswith("urn:cen.eu:en16931:2017#compliant#"), "EN 16931 (CIUS)").otherwise("UNKNOWN")


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(text)


def _field(path: str) -> Column:
    return F.nullif(F.trim(F.col(path)), F.lit(""))


def parse(documents: DataFrame) -> DataFrame:
    """doc_id, syntax, profile, invoice fields, lines and totals. documents: doc_id, xml."""
    d = documents.select("doc_id", syntax_of(F.col("xml")).alias("syntax"), _bare(F.col("xml")).alias("x"))
    d = d.select("doc_id", "syntax", F.when(F.col("syntax") == "CII", F.from_xml("x", CII, OPTIONS)).alias("c"), F.when(F.col("syntax") == "UBL", F.from_xml("x", UBL, OPTIONS)).alias("u"))
    tx, doc = "c.SupplyChainTradeTransaction", "c.ExchangedDocument"
    pay, total = f"{tx}.ApplicableHeaderTradeSettlement", f"{tx}.ApplicableHeaderTradeSettlement.SpecifiedTradeSettlementHeaderMonetarySummation"

    def cii_line(i):
        s, a = i["SpecifiedLineTradeSettlement"], i["SpecifiedLineTradeAgreement"]["NetPriceProductTradePrice"]
        values = (i["AssociatedDocumentLineDocument"]["LineID"], i["SpecifiedTradeProduct"]["Name"], i["SpecifiedLineTradeDelivery"]["BilledQuantity"]["_VALUE"], F.coalesce(i["SpecifiedLineTradeDelivery"]["BilledQuantity"]["_unitCode"], F.lit("C62")), a["ChargeAmount"], a["BasisQuantity"], s["ApplicableTradeTax"]["CategoryCode"], F.coalesce(s["ApplicableTradeTax"]["RateApplicablePercent"], F.lit("0")), s["SpecifiedTradeSettlementLineMonetarySummation"]["LineTotalAmount"])
        return _line(values)

    def ubl_line(i):
        q = F.coalesce(i["InvoicedQuantity"], i["CreditedQuantity"])
        tax = i["Item"]["ClassifiedTaxCategory"]
        return _line((i["ID"], i["Item"]["Name"], q["_VALUE"], F.coalesce(q["_unitCode"], F.lit("C62")), i["Price"]["PriceAmount"]["_VALUE"], i["Price"]["BaseQuantity"]["_VALUE"], tax["ID"], F.coalesce(tax["Percent"], F.lit("0")), i["LineExtensionAmount"]["_VALUE"]))

    either = lambda a, b: F.coalesce(_field(a), _field(b))
    vat_total = F.try_element_at(F.filter(f"{total}.TaxTotalAmount", lambda t: t["_currencyID"].isNull() | (t["_currencyID"] == F.col(f"{pay}.InvoiceCurrencyCode"))), F.lit(1))["_VALUE"]
    urn = either("c.ExchangedDocumentContext.GuidelineSpecifiedDocumentContextParameter.ID", "u.CustomizationID")
    return d.select(
        "doc_id", "syntax", profile_of(urn).alias("profile"), F.nullif(F.regexp_extract(F.coalesce(urn, F.lit("")), XRECHNUNG, 1), F.lit("")).alias("version"),
        either(f"{doc}.ID", "u.ID").alias("invoice_number"), F.coalesce(iso_date(_field(f"{doc}.IssueDateTime.DateTimeString")), _field("u.IssueDate")).alias("issue_date"),
        F.coalesce(_field(f"{doc}.TypeCode"), _field("u.InvoiceTypeCode"), _field("u.CreditNoteTypeCode")).alias("type_code"), either(f"{pay}.InvoiceCurrencyCode", "u.DocumentCurrencyCode").alias("currency"),
        either(f"{tx}.ApplicableHeaderTradeAgreement.BuyerReference", "u.BuyerReference").alias("buyer_reference"),
        _field(f"{tx}.ApplicableHeaderTradeAgreement.SellerTradeParty.Name").alias("seller_name"), _field(f"{tx}.ApplicableHeaderTradeAgreement.BuyerTradeParty.Name").alias("buyer_name"),
        F.coalesce(iso_date(_field(f"{pay}.SpecifiedTradePaymentTerms.DueDateDateTime.DateTimeString")), _field("u.DueDate")).alias("due_date"),
        _field(f"{pay}.SpecifiedTradePaymentTerms.Description").alias("terms"), _field(f"{pay}.SpecifiedTradeSettlementPaymentMeans.PayeePartyCreditorFinancialAccount.IBANID").alias("iban"),
        F.coalesce(F.transform(f"{tx}.IncludedSupplyChainTradeLineItem", cii_line), F.transform(F.coalesce("u.InvoiceLine", "u.CreditNoteLine"), ubl_line)).alias("lines"),
        F.col(f"{pay}.ApplicableTradeTax").alias("vat_breakdown"), F.col(f"{pay}.SpecifiedTradeAllowanceCharge").alias("adjustments"),
        either(f"{total}.LineTotalAmount", "u.LegalMonetaryTotal.LineExtensionAmount._VALUE").alias("line_total"), either(f"{total}.TaxBasisTotalAmount", "u.LegalMonetaryTotal.TaxExclusiveAmount._VALUE").alias("net_total"),
        F.nullif(F.trim(vat_total), F.lit("")).alias("vat_total"), either(f"{total}.GrandTotalAmount", "u.LegalMonetaryTotal.TaxInclusiveAmount._VALUE").alias("gross_total"), either(f"{total}.DuePayableAmount", "u.LegalMonetaryTotal.PayableAmount._VALUE").alias("payable_amount"),
    )


LINE = ("position", "description", "quantity", "unit", "net_price", "price_base_quantity", "vat_category", "vat_rate", "line_net_amount")


def _line(values) -> Column:
    return F.struct(*[F.trim(v).alias(n) for n, v in zip(LINE, values)])


SKONTO = r"#SKONTO#TAGE=(\d+)#PROZENT=(\d+(?:\.\d+)?)#"


def payment_terms(text: Column) -> Column:
    """struct<terms, discount_days, discount_percent>: the first discount segment apart from the free text."""
    days = F.regexp_extract(text, SKONTO, 1)
    free = F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?s)^(.*?){SKONTO}[^\n]*\n?", "$1"), r"\n{2,}", "\n"))
    return F.struct(F.nullif(free, F.lit("")).alias("terms"), days.try_cast("int").alias("discount_days"), F.nullif(F.regexp_extract(text, SKONTO, 2), F.lit("")).alias("discount_percent"))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, *inside: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name}>"))


def to_cii(invoices: DataFrame) -> DataFrame:
    """doc_id, xml: what parse() reads back. invoices: parse() columns."""
    value = lambda tag, column: F.when(column.isNotNull(), _tag(tag, _escape(column))).otherwise("")
    stamp = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(f'<ram:{tag}><udt:DateTimeString format="102">'), F.replace(c, F.lit("-")), F.lit(f"</udt:DateTimeString></ram:{tag}>"))).otherwise("")

    def line(i):
        quantity = F.concat(F.lit('<ram:BilledQuantity unitCode="'), i["unit"], F.lit('">'), i["quantity"], F.lit("</ram:BilledQuantity>"))
        return _tag(
            "ram:IncludedSupplyChainTradeLineItem",
            _tag("ram:AssociatedDocumentLineDocument", value("ram:LineID", i["position"])), _tag("ram:SpecifiedTradeProduct", value("ram:Name", i["description"])),
            _tag("ram:SpecifiedLineTradeAgreement", _tag("ram:NetPriceProductTradePrice", value("ram:ChargeAmount", i["net_price"]), value("ram:BasisQuantity", i["price_base_quantity"]))),
            _tag("ram:SpecifiedLineTradeDelivery", quantity),
            _tag("ram:SpecifiedLineTradeSettlement", _tag("ram:ApplicableTradeTax", value("ram:CategoryCode", i["vat_category"]), value("ram:RateApplicablePercent", i["vat_rate"])), _tag("ram:SpecifiedTradeSettlementLineMonetarySummation", value("ram:LineTotalAmount", i["line_net_amount"]))),
        )

    c = F.col
    head = '<rsm:CrossIndustryInvoice xmlns:rsm="urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100" xmlns:ram="urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100" xmlns:udt="urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100">'
    totals = _tag("ram:SpecifiedTradeSettlementHeaderMonetarySummation", value("ram:LineTotalAmount", c("line_total")), value("ram:TaxBasisTotalAmount", c("net_total")), value("ram:TaxTotalAmount", c("vat_total")), value("ram:GrandTotalAmount", c("gross_total")), value("ram:DuePayableAmount", c("payable_amount")))
    return invoices.select("doc_id", F.concat(
        F.lit(head), _tag("rsm:ExchangedDocumentContext", _tag("ram:GuidelineSpecifiedDocumentContextParameter", F.lit("<ram:ID>urn:cen.eu:en16931:2017</ram:ID>"))),
        _tag("rsm:ExchangedDocument", value("ram:ID", c("invoice_number")), value("ram:TypeCode", c("type_code")), stamp("IssueDateTime", c("issue_date"))),
        _tag("rsm:SupplyChainTradeTransaction", F.array_join(F.transform("lines", line), ""),
             _tag("ram:ApplicableHeaderTradeAgreement", value("ram:BuyerReference", c("buyer_reference")), _tag("ram:SellerTradeParty", value("ram:Name", c("seller_name"))), _tag("ram:BuyerTradeParty", value("ram:Name", c("buyer_name")))),
             _tag("ram:ApplicableHeaderTradeSettlement", value("ram:InvoiceCurrencyCode", c("currency")), _tag("ram:SpecifiedTradePaymentTerms", value("ram:Description", c("terms")), stamp("DueDateDateTime", c("due_date"))), totals)),
        F.lit("</rsm:CrossIndustryInvoice>"),
    ).alias("xml"))

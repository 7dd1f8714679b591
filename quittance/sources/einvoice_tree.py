"""Whole e-invoices between XML (CII and UBL) and one nested row: parties, addresses, lines with adjustments, VAT groups, totals, payment.

What is read is written down once as paths; the schema for Spark's XML parser comes from the paths that were asked for. Documents are
parsed once, in the JVM; those that declare types or entities are refused, malformed and unknown ones give nulls.

Cases: empty elements are null; groups without any value are null (a party's address is always there); missing VAT rates are 0 and
missing units C62; lists are empty where nothing is listed; of repeated single elements the parser keeps one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scope import let
from . import einvoice_xml as plain

FIELDS = (
    "invoice_number", "issue_date", "type_code", "currency", "delivery_date", "delivery_name", "delivery_address", "billing_period_start", "billing_period_end", "order_reference", "contract_reference",
    "preceding_invoice_number", "preceding_invoice_date", "notes", "seller", "buyer", "lines", "allowances", "charges", "vat_breakdown", "totals", "payment",
)
URN = {"CII": "urn:cen.eu:en16931:2017", "UBL": "urn:cen.eu:en16931:2017"}


# --- reading ---------------------------------------------------------------------------------


class _Node:
    """What is asked of an element."""

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.attributes: dict[str, None] = {}
        self.repeated = False

    def at(self, path: str) -> _Node:
        node = self
        for part in path.split("/"):
            node = node.children.setdefault(part, _Node())
        return node

    def ddl(self) -> str:
        inside = [f"{n}: {c.ddl()}" for n, c in self.children.items()] or (["_VALUE: STRING"] if self.attributes else [])
        inside += [f"_{a}: STRING" for a in self.attributes]
        made = f"STRUCT<{', '.join(inside)}>" if inside else "STRING"
        return f"ARRAY<{made}>" if self.repeated else made


class _Element:
    """An element of the parsed document, and the elements below it by path."""

    def __init__(self, node: _Node, column: Column):
        self.node, self.column = node, column

    def _get(self, path: str) -> tuple[_Node, Column]:
        column = self.column
        for part in path.split("/") if path else ():
            column = column[part]
        return (self.node.at(path) if path else self.node), column

    def text(self, path: str = "") -> Column:
        node, column = self._get(path)
        return F.nullif(F.trim(column["_VALUE"] if node.attributes else column), F.lit(""))

    def date(self, path: str) -> Column:
        return plain.iso_date(self.text(path))

    def attribute(self, path: str, name: str) -> Column:
        node, column = self._get(path)
        node.attributes[name] = None
        return F.nullif(F.trim(column[f"_{name}"]), F.lit(""))

    def child(self, path: str) -> _Element:
        return _Element(*self._get(path))

    def each(self, path: str, made: Callable[[_Element], Column]) -> Column:
        node, column = self._get(path)
        node.repeated = True
        nothing = F.from_json(F.lit("[]"), node.ddl())
        return F.transform(F.coalesce(column, nothing), lambda x: made(_Element(node, x)))

    def where(self, path: str, value: Callable[[_Element], Column], told: Callable[[_Element], Column], last: bool = False) -> Column:
        """value of the first (or last) of repeated elements for which `told` holds and value is not null."""
        found = self.each(path, lambda e: F.when(told(e), value(e)))
        return F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(-1 if last else 1))


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _any(**fields: Column) -> Column:
    """A struct, null where all fields are."""
    return F.when(F.coalesce(*[F.when(c.isNotNull(), 1) for c in fields.values()]).isNotNull(), _struct(**fields))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit("0"))


_ADDRESS = ("street", "additional_street", "address_line_3", "postcode", "city", "country", "country_subdivision")
_CII_ADDRESS = ("LineOne", "LineTwo", "LineThree", "PostcodeCode", "CityName", "CountryID", "CountrySubDivisionName")
_UBL_ADDRESS = ("StreetName", "AdditionalStreetName", "AddressLine/Line", "PostalZone", "CityName", "Country/IdentificationCode", "CountrySubentity")


def _address(e: _Element, paths: tuple[str, ...], always: bool = False) -> Column:
    fields = {n: e.text(p) for n, p in zip(_ADDRESS, paths)}
    return _struct(**fields) if always else _any(**fields)


def _split(entries: Column, charge: bool) -> Column:
    said = lambda x: x["indicator"]
    # the usual words are compared as they are
    true = lambda x: F.coalesce((said(x) == "true") | ((said(x) != "false") & (F.lower(said(x)) == "true")), F.lit(False))
    kept = F.filter(entries, true if charge else lambda x: ~true(x))
    return F.transform(kept, lambda x: x.dropFields("indicator"))


def _cii_adjustment(taxed: bool):
    def made(e: _Element) -> Column:
        tax = {"vat_category": e.text("CategoryTradeTax/CategoryCode"), "vat_rate": _zero(e.text("CategoryTradeTax/RateApplicablePercent"))} if taxed else {}
        return _struct(indicator=e.text("ChargeIndicator/Indicator"), amount=e.text("ActualAmount"), reason=e.text("Reason"), reason_code=e.text("ReasonCode"), base_amount=e.text("BasisAmount"), percent=e.text("CalculationPercent"), **tax)

    return made


def _ubl_adjustment(taxed: bool):
    def made(e: _Element) -> Column:
        tax = {"vat_category": e.text("TaxCategory/ID"), "vat_rate": _zero(e.text("TaxCategory/Percent"))} if taxed else {}
        return _struct(indicator=e.text("ChargeIndicator"), amount=e.text("Amount"), reason=e.text("AllowanceChargeReason"), reason_code=e.text("AllowanceChargeReasonCode"), base_amount=e.text("BaseAmount"), percent=e.text("MultiplierFactorNumeric"), **tax)

    return made


def _cii_party(e: _Element, seller: bool, buyer_reference: Column | None = None) -> Column:
    of = lambda scheme: e.where("SpecifiedTaxRegistration", lambda r: r.text("ID"), lambda r: r.attribute("ID", "schemeID") == scheme, last=True)
    fields = {
        "id": e.text("ID"), "global_id": e.where("GlobalID", lambda g: g.text(), lambda g: g.attribute("", "schemeID") == "0088", last=True), "name": e.text("Name"), "address": _address(e.child("PostalTradeAddress"), _CII_ADDRESS, True), "vat_id": of("VA"),
        "electronic_address": e.text("URIUniversalCommunication/URIID"), "electronic_address_scheme": e.attribute("URIUniversalCommunication/URIID", "schemeID"),
        "contact": _any(name=e.text("DefinedTradeContact/PersonName"), phone=e.text("DefinedTradeContact/TelephoneUniversalCommunication/CompleteNumber"), email=e.text("DefinedTradeContact/EmailURIUniversalCommunication/URIID")),
    }
    organisation = e.child("SpecifiedLegalOrganization")
    if seller:
        fields |= {"tax_number": of("FC"), "trading_name": organisation.text("TradingBusinessName"), "legal": _any(commercial_register=organisation.text("ID"), additional_info=e.text("Description"))}
    else:
        fields |= {"buyer_reference": buyer_reference, "legal_registration_id": organisation.text("ID")}
    return F.when(e.column.isNotNull(), _struct(**fields))


def _ubl_party(e: _Element, seller: bool, buyer_reference: Column | None = None) -> Column:
    scheme = lambda i: F.coalesce(i.attribute("ID", "schemeID"), F.lit(""))
    taxes = lambda vat: e.where("PartyTaxScheme", lambda t: t.text("CompanyID"), lambda t: F.coalesce(t.text("TaxScheme/ID") == "VAT", F.lit(False)) == F.lit(vat), last=True)
    said, name = e.text("PartyName/Name"), F.coalesce(e.text("PartyLegalEntity/RegistrationName"), e.text("PartyName/Name"))
    fields = {
        "id": e.where("PartyIdentification", lambda i: i.text("ID"), lambda i: ~scheme(i).isin("0088", "SEPA")), "global_id": e.where("PartyIdentification", lambda i: i.text("ID"), lambda i: scheme(i) == "0088", last=True), "name": name,
        "address": _address(e.child("PostalAddress"), _UBL_ADDRESS, True), "vat_id": taxes(True), "electronic_address": e.text("EndpointID"), "electronic_address_scheme": e.attribute("EndpointID", "schemeID"),
        "contact": _any(name=e.text("Contact/Name"), phone=e.text("Contact/Telephone"), email=e.text("Contact/ElectronicMail")),
    }
    register = e.text("PartyLegalEntity/CompanyID")
    if seller:
        fields |= {"tax_number": taxes(False), "trading_name": F.when(said != name, said), "legal": _any(commercial_register=register, additional_info=e.text("PartyLegalEntity/CompanyLegalForm"))}
    else:
        fields |= {"buyer_reference": buyer_reference, "legal_registration_id": register}
    return F.when(e.column.isNotNull(), _struct(**fields))


def _payment(creditor_id: Column, due: Column, terms: Column, means_code: Column, **fields: Column) -> Column:
    def made(told: Column) -> Column:
        more = {**fields, "creditor_id": creditor_id, "due_date": due, **{n: told[n] for n in ("terms", "discount_days", "discount_percent")}}
        some = reduce(lambda x, y: x | y, [c.isNotNull() for c in (means_code, *more.values())])
        return F.when(some, _struct(means_code=F.coalesce(means_code, F.lit("1")), **more))

    return let(plain.payment_terms(F.coalesce(terms, F.lit(""))), made)


def _read_cii(root: _Element) -> dict[str, Column]:
    doc, tx = root.child("ExchangedDocument"), root.child("SupplyChainTradeTransaction")
    agreed, sent, paid = (tx.child(f"ApplicableHeaderTrade{x}") for x in ("Agreement", "Delivery", "Settlement"))
    currency, means, terms, total = paid.text("InvoiceCurrencyCode"), paid.child("SpecifiedTradeSettlementPaymentMeans"), paid.child("SpecifiedTradePaymentTerms"), paid.child("SpecifiedTradeSettlementHeaderMonetarySummation")

    def line(e: _Element) -> Column:
        product, price, of = e.child("SpecifiedTradeProduct"), e.child("SpecifiedLineTradeAgreement"), e.child("SpecifiedLineTradeSettlement")
        own = of.each("SpecifiedTradeAllowanceCharge", _cii_adjustment(False))
        return _struct(
            position=e.text("AssociatedDocumentLineDocument/LineID"), note=e.text("AssociatedDocumentLineDocument/IncludedNote/Content"), description=product.text("Name"), item_description=product.text("Description"),
            seller_article_number=product.text("SellerAssignedID"), buyer_article_number=product.text("BuyerAssignedID"), gtin=product.where("GlobalID", lambda g: g.text(), lambda g: g.attribute("", "schemeID") == "0160", last=True),
            gross_price=price.text("GrossPriceProductTradePrice/ChargeAmount"), net_price=price.text("NetPriceProductTradePrice/ChargeAmount"), price_base_quantity=price.text("NetPriceProductTradePrice/BasisQuantity"),
            quantity=e.text("SpecifiedLineTradeDelivery/BilledQuantity"), unit=F.coalesce(e.attribute("SpecifiedLineTradeDelivery/BilledQuantity", "unitCode"), F.lit("C62")), vat_category=of.text("ApplicableTradeTax/CategoryCode"),
            vat_rate=_zero(of.text("ApplicableTradeTax/RateApplicablePercent")), line_net_amount=of.text("SpecifiedTradeSettlementLineMonetarySummation/LineTotalAmount"), allowances=_split(own, False), charges=_split(own, True),
        )

    adjusted = paid.each("SpecifiedTradeAllowanceCharge", _cii_adjustment(True))
    group = lambda e: _struct(category=e.text("CategoryCode"), rate=_zero(e.text("RateApplicablePercent")), basis_amount=e.text("BasisAmount"), tax_amount=e.text("CalculatedAmount"), exemption_reason=e.text("ExemptionReason"), exemption_reason_code=e.text("ExemptionReasonCode"))
    vat_total = total.where("TaxTotalAmount", lambda e: e.text(), lambda e: F.coalesce(e.attribute("", "currencyID") == currency, F.lit(True)))
    notes = doc.each("IncludedNote", lambda e: e.text("Content"))
    return {
        "invoice_number": doc.text("ID"), "issue_date": doc.date("IssueDateTime/DateTimeString"), "type_code": doc.text("TypeCode"), "currency": currency, "delivery_date": sent.date("ActualDeliverySupplyChainEvent/OccurrenceDateTime/DateTimeString"),
        "delivery_name": sent.text("ShipToTradeParty/Name"), "delivery_address": _address(sent.child("ShipToTradeParty/PostalTradeAddress"), _CII_ADDRESS), "billing_period_start": paid.date("BillingSpecifiedPeriod/StartDateTime/DateTimeString"),
        "billing_period_end": paid.date("BillingSpecifiedPeriod/EndDateTime/DateTimeString"), "order_reference": agreed.text("BuyerOrderReferencedDocument/IssuerAssignedID"), "contract_reference": agreed.text("ContractReferencedDocument/IssuerAssignedID"),
        "preceding_invoice_number": paid.text("InvoiceReferencedDocument/IssuerAssignedID"), "preceding_invoice_date": paid.date("InvoiceReferencedDocument/FormattedIssueDateTime/DateTimeString"), "notes": F.filter(notes, lambda n: n.isNotNull()),
        "seller": _cii_party(agreed.child("SellerTradeParty"), True), "buyer": _cii_party(agreed.child("BuyerTradeParty"), False, agreed.text("BuyerReference")), "lines": tx.each("IncludedSupplyChainTradeLineItem", line),
        "allowances": _split(adjusted, False), "charges": _split(adjusted, True), "vat_breakdown": paid.each("ApplicableTradeTax", group),
        "totals": _struct(line_total=total.text("LineTotalAmount"), charges=total.text("ChargeTotalAmount"), allowances=total.text("AllowanceTotalAmount"), net_total=total.text("TaxBasisTotalAmount"), vat_total=vat_total, gross_total=total.text("GrandTotalAmount"), prepaid_amount=total.text("TotalPrepaidAmount"), rounding_amount=total.text("RoundingAmount"), payable_amount=total.text("DuePayableAmount")),
        "payment": _payment(paid.text("CreditorReferenceID"), terms.date("DueDateDateTime/DateTimeString"), terms.text("Description"), means_code=means.text("TypeCode"), iban=means.text("PayeePartyCreditorFinancialAccount/IBANID"), account_name=means.text("PayeePartyCreditorFinancialAccount/AccountName"), bic=means.text("PayeeSpecifiedCreditorFinancialInstitution/BICID"), debtor_iban=means.text("PayerPartyDebtorFinancialAccount/IBANID"), payment_reference=paid.text("PaymentReference"), mandate_reference=terms.text("DirectDebitMandateID")),
    }


def _read_ubl(root: _Element) -> dict[str, Column]:
    currency, means, total = root.text("DocumentCurrencyCode"), root.child("PaymentMeans"), root.child("LegalMonetaryTotal")
    supplier, customer = root.child("AccountingSupplierParty/Party"), root.child("AccountingCustomerParty/Party")

    def line(quantity: str):
        def made(e: _Element) -> Column:
            item, own = e.child("Item"), e.each("AllowanceCharge", _ubl_adjustment(False))
            return _struct(
                position=e.text("ID"), note=e.text("Note"), description=item.text("Name"), item_description=item.text("Description"), seller_article_number=item.text("SellersItemIdentification/ID"), buyer_article_number=item.text("BuyersItemIdentification/ID"),
                gtin=item.where("StandardItemIdentification", lambda s: s.text("ID"), lambda s: s.attribute("ID", "schemeID") == "0160", last=True), gross_price=e.text("Price/AllowanceCharge/BaseAmount"), net_price=e.text("Price/PriceAmount"), price_base_quantity=e.text("Price/BaseQuantity"),
                quantity=e.text(quantity), unit=F.coalesce(e.attribute(quantity, "unitCode"), F.lit("C62")), vat_category=item.text("ClassifiedTaxCategory/ID"), vat_rate=_zero(item.text("ClassifiedTaxCategory/Percent")), line_net_amount=e.text("LineExtensionAmount"), allowances=_split(own, False), charges=_split(own, True),
            )

        return made

    adjusted = root.each("AllowanceCharge", _ubl_adjustment(True))
    group = lambda e: _struct(category=e.text("TaxCategory/ID"), rate=_zero(e.text("TaxCategory/Percent")), basis_amount=e.text("TaxableAmount"), tax_amount=e.text("TaxAmount"), exemption_reason=e.text("TaxCategory/TaxExemptionReason"), exemption_reason_code=e.text("TaxCategory/TaxExemptionReasonCode"))
    vat_total = root.where("TaxTotal", lambda e: e.text("TaxAmount"), lambda e: F.coalesce(e.attribute("TaxAmount", "currencyID") == currency, F.lit(True)))
    sepa = lambda e: e.where("PartyIdentification", lambda i: i.text("ID"), lambda i: i.attribute("ID", "schemeID") == "SEPA")
    return {
        "invoice_number": root.text("ID"), "issue_date": root.text("IssueDate"), "type_code": F.coalesce(root.text("InvoiceTypeCode"), root.text("CreditNoteTypeCode")), "currency": currency, "delivery_date": root.text("Delivery/ActualDeliveryDate"),
        "delivery_name": root.text("Delivery/DeliveryParty/PartyName/Name"), "delivery_address": _address(root.child("Delivery/DeliveryLocation/Address"), _UBL_ADDRESS), "billing_period_start": root.text("InvoicePeriod/StartDate"), "billing_period_end": root.text("InvoicePeriod/EndDate"),
        "order_reference": root.text("OrderReference/ID"), "contract_reference": root.text("ContractDocumentReference/ID"), "preceding_invoice_number": root.text("BillingReference/InvoiceDocumentReference/ID"), "preceding_invoice_date": root.text("BillingReference/InvoiceDocumentReference/IssueDate"),
        "notes": F.filter(root.each("Note", lambda e: e.text()), lambda n: n.isNotNull()), "seller": _ubl_party(supplier, True), "buyer": _ubl_party(customer, False, root.text("BuyerReference")),
        "lines": F.concat(root.each("InvoiceLine", line("InvoicedQuantity")), root.each("CreditNoteLine", line("CreditedQuantity"))), "allowances": _split(adjusted, False), "charges": _split(adjusted, True), "vat_breakdown": F.flatten(root.each("TaxTotal", lambda e: e.each("TaxSubtotal", group))),
        "totals": _struct(line_total=total.text("LineExtensionAmount"), charges=total.text("ChargeTotalAmount"), allowances=total.text("AllowanceTotalAmount"), net_total=total.text("TaxExclusiveAmount"), vat_total=vat_total, gross_total=total.text("TaxInclusiveAmount"), prepaid_amount=total.text("PrepaidAmount"), rounding_amount=total.text("PayableRoundingAmount"), payable_amount=total.text("PayableAmount")),
        "payment": _payment(F.coalesce(sepa(root.child("PayeeParty")), sepa(supplier)), F.coalesce(root.text("DueDate"), means.text("PaymentDueDate")), root.text("PaymentTerms/Note"), means_code=means.text("PaymentMeansCode"), iban=means.text("PayeeFinancialAccount/ID"), account_name=means.text("PayeeFinancialAccount/Name"), bic=means.text("PayeeFinancialAccount/FinancialInstitutionBranch/ID"), debtor_iban=means.text("PaymentMandate/PayerFinancialAccount/ID"), payment_reference=means.text("PaymentID"), mandate_reference=means.text("PaymentMandate/ID")),
    }


_READERS = {"CII": _read_cii, "UBL": _read_ubl}


def _asked(read: Callable, name: str) -> tuple[str, dict[str, Column]]:
    """The schema of what a reader asks for, and its columns: it is called twice, as attributes change how a text is got."""
    node = _Node()
    read(_Element(node, F.col(name)))
    fields = read(_Element(node, F.col(name)))
    return ", ".join(f"{n} {c.ddl()}" for n, c in node.children.items()), fields


def parse(documents: DataFrame) -> DataFrame:
    """doc_id, syntax and FIELDS of each document. documents: doc_id, xml."""
    d = documents.select("doc_id", plain.syntax_of(F.col("xml")).alias("syntax"), plain._bare(F.col("xml")).alias("x"))
    made = {syntax: _asked(read, syntax) for syntax, read in _READERS.items()}
    d = d.select("doc_id", "syntax", *[F.when(F.col("syntax") == s, F.from_xml("x", ddl, plain.OPTIONS)).alias(s) for s, (ddl, _) in made.items()])
    pick = lambda f: F.when(F.col("syntax") == "CII", made["CII"][1][f]).when(F.col("syntax") == "UBL", made["UBL"][1][f])
    return d.select("doc_id", "syntax", *[pick(f).alias(f) for f in FIELDS])


# --- writing ---------------------------------------------------------------------------------


@dataclass
class _Xml:
    """Text of an element and whether there is any: kept apart, so that no text is made twice to learn that."""

    text: Column
    some: Column

    def when(self, told: Column) -> _Xml:
        return _Xml(F.when(told, self.text).otherwise(""), told & self.some)


def _always(text: str) -> _Xml:
    return _Xml(F.lit(text), F.lit(True))


def _full(name: str, *inside: _Xml, **attributes: Column | str) -> _Xml:
    """An element; nothing where there is nothing inside."""
    told = [F.concat(F.lit(f' {a}="'), plain._escape(F.lit(v) if isinstance(v, str) else v), F.lit('"')) for a, v in attributes.items()]
    some = reduce(lambda x, y: x | y, [x.some for x in inside])
    return _Xml(F.when(some, F.concat(F.lit(f"<{name}"), *told, F.lit(">"), *[x.text for x in inside], F.lit(f"</{name}>"))).otherwise(""), some)


def _leaf(name: str, value: Column, some: Column | None = None, **attributes: Column | str) -> _Xml:
    """An element with a value. some: whether there is one, where that is known more cheaply."""
    return _full(name, _Xml(plain._escape(value), value.isNotNull() if some is None else some), **attributes)


def _many(values: Column, made: Callable[[Column], _Xml]) -> _Xml:
    return _Xml(F.coalesce(F.array_join(F.transform(values, lambda v: made(v).text), ""), F.lit("")), F.coalesce(F.size(values) > 0, F.lit(False)))


def _stamp(name: str, value: Column, kind: str = "udt") -> _Xml:
    return _full(name, _leaf(f"{kind}:DateTimeString", F.replace(value, F.lit("-")), value.isNotNull(), format="102"))


def _terms(payment: Column) -> Column:
    skonto = F.concat(F.lit("#SKONTO#TAGE="), payment["discount_days"].cast("string"), F.lit("#PROZENT="), payment["discount_percent"], F.lit("#"))
    return F.when(skonto.isNotNull(), F.concat(F.concat_ws("\n", skonto, payment["terms"]), F.lit("\n"))).otherwise(payment["terms"])


def _has_terms(payment: Column) -> Column:
    return payment["terms"].isNotNull() | (payment["discount_days"].isNotNull() & payment["discount_percent"].isNotNull())


def _rated(category: Column) -> Column:
    """What is outside of VAT has no rate."""
    return ~category.eqNullSafe("O")


def _cii_address_xml(a: Column) -> _Xml:
    order = ("postcode", "street", "additional_street", "address_line_3", "city", "country", "country_subdivision")
    tags = dict(zip(_ADDRESS, _CII_ADDRESS))
    return _full("ram:PostalTradeAddress", *[_leaf(f"ram:{tags[n]}", a[n]) for n in order])


def _cii_party_xml(tag: str, p: Column, seller: bool) -> _Xml:
    register, trading = (p["legal"]["commercial_register"], [_leaf("ram:TradingBusinessName", p["trading_name"])]) if seller else (p["legal_registration_id"], [])
    number = lambda value, scheme: _full("ram:SpecifiedTaxRegistration", _leaf("ram:ID", value, schemeID=scheme))
    c = p["contact"]
    return _full(
        tag, _leaf("ram:ID", p["id"]), _leaf("ram:GlobalID", p["global_id"], schemeID="0088"), _leaf("ram:Name", p["name"]), *([_leaf("ram:Description", p["legal"]["additional_info"])] if seller else []),
        _full("ram:SpecifiedLegalOrganization", _leaf("ram:ID", register), *trading),
        _full("ram:DefinedTradeContact", _leaf("ram:PersonName", c["name"]), _full("ram:TelephoneUniversalCommunication", _leaf("ram:CompleteNumber", c["phone"])), _full("ram:EmailURIUniversalCommunication", _leaf("ram:URIID", c["email"]))),
        _cii_address_xml(p["address"]), _full("ram:URIUniversalCommunication", _leaf("ram:URIID", p["electronic_address"], schemeID=p["electronic_address_scheme"])), number(p["vat_id"], "VA"), *([number(p["tax_number"], "FC")] if seller else []),
    )


def _cii_adjustment_xml(charge: bool, taxed: bool):
    def made(x: Column) -> _Xml:
        tax = [_full("ram:CategoryTradeTax", _always("<ram:TypeCode>VAT</ram:TypeCode>"), _leaf("ram:CategoryCode", x["vat_category"]), _leaf("ram:RateApplicablePercent", x["vat_rate"]).when(_rated(x["vat_category"])))] if taxed else []
        return _full("ram:SpecifiedTradeAllowanceCharge", _always(f"<ram:ChargeIndicator><udt:Indicator>{str(charge).lower()}</udt:Indicator></ram:ChargeIndicator>"), _leaf("ram:CalculationPercent", x["percent"]), _leaf("ram:BasisAmount", x["base_amount"]), _leaf("ram:ActualAmount", x["amount"]), _leaf("ram:ReasonCode", x["reason_code"]), _leaf("ram:Reason", x["reason"]), *tax)

    return made


def cii() -> Column:
    """The document of an invoice with FIELDS."""
    c = F.col
    p, t, buyer = c("payment"), c("totals"), c("buyer")

    def line(i: Column) -> _Xml:
        return _full(
            "ram:IncludedSupplyChainTradeLineItem", _full("ram:AssociatedDocumentLineDocument", _leaf("ram:LineID", i["position"]), _full("ram:IncludedNote", _leaf("ram:Content", i["note"]))),
            _full("ram:SpecifiedTradeProduct", _leaf("ram:GlobalID", i["gtin"], schemeID="0160"), _leaf("ram:SellerAssignedID", i["seller_article_number"]), _leaf("ram:BuyerAssignedID", i["buyer_article_number"]), _leaf("ram:Name", i["description"]), _leaf("ram:Description", i["item_description"])),
            _full("ram:SpecifiedLineTradeAgreement", _full("ram:GrossPriceProductTradePrice", _leaf("ram:ChargeAmount", i["gross_price"])), _full("ram:NetPriceProductTradePrice", _leaf("ram:ChargeAmount", i["net_price"]), _leaf("ram:BasisQuantity", i["price_base_quantity"], unitCode=i["unit"]))),
            _full("ram:SpecifiedLineTradeDelivery", _leaf("ram:BilledQuantity", i["quantity"], unitCode=i["unit"])),
            _full("ram:SpecifiedLineTradeSettlement", _full("ram:ApplicableTradeTax", _always("<ram:TypeCode>VAT</ram:TypeCode>"), _leaf("ram:CategoryCode", i["vat_category"]), _leaf("ram:RateApplicablePercent", i["vat_rate"]).when(_rated(i["vat_category"]))),
                  _many(i["allowances"], _cii_adjustment_xml(False, False)), _many(i["charges"], _cii_adjustment_xml(True, False)), _full("ram:SpecifiedTradeSettlementLineMonetarySummation", _leaf("ram:LineTotalAmount", i["line_net_amount"]))),
        )

    def group(g: Column) -> _Xml:
        rate = _leaf("ram:RateApplicablePercent", g["rate"]).when(_rated(g["category"]))
        return _full("ram:ApplicableTradeTax", _leaf("ram:CalculatedAmount", g["tax_amount"]), _always("<ram:TypeCode>VAT</ram:TypeCode>"), _leaf("ram:ExemptionReason", g["exemption_reason"]), _leaf("ram:BasisAmount", g["basis_amount"]), _leaf("ram:CategoryCode", g["category"]), _leaf("ram:ExemptionReasonCode", g["exemption_reason_code"]), rate)

    head = 'xmlns:rsm="urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100" xmlns:ram="urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100" xmlns:qdt="urn:un:unece:uncefact:data:standard:QualifiedDataType:100" xmlns:udt="urn:un:unece:uncefact:data:standard:UnqualifiedDataType:100"'
    agreement = _full("ram:ApplicableHeaderTradeAgreement", _leaf("ram:BuyerReference", buyer["buyer_reference"]), _cii_party_xml("ram:SellerTradeParty", c("seller"), True), _cii_party_xml("ram:BuyerTradeParty", buyer, False), _full("ram:BuyerOrderReferencedDocument", _leaf("ram:IssuerAssignedID", c("order_reference"))), _full("ram:ContractReferencedDocument", _leaf("ram:IssuerAssignedID", c("contract_reference"))))
    delivery = _full("ram:ApplicableHeaderTradeDelivery", _full("ram:ShipToTradeParty", _leaf("ram:Name", c("delivery_name")), _cii_address_xml(c("delivery_address"))), _full("ram:ActualDeliverySupplyChainEvent", _stamp("ram:OccurrenceDateTime", c("delivery_date"))))
    means = _full("ram:SpecifiedTradeSettlementPaymentMeans", _leaf("ram:TypeCode", p["means_code"]), _full("ram:PayerPartyDebtorFinancialAccount", _leaf("ram:IBANID", p["debtor_iban"])), _full("ram:PayeePartyCreditorFinancialAccount", _leaf("ram:IBANID", p["iban"]), _leaf("ram:AccountName", p["account_name"])), _full("ram:PayeeSpecifiedCreditorFinancialInstitution", _leaf("ram:BICID", p["bic"])))
    summed = [_leaf(f"ram:{tag}", t[n]) for n, tag in (("line_total", "LineTotalAmount"), ("charges", "ChargeTotalAmount"), ("allowances", "AllowanceTotalAmount"), ("net_total", "TaxBasisTotalAmount"))]
    summed += [_leaf("ram:TaxTotalAmount", t["vat_total"], currencyID=c("currency")), *[_leaf(f"ram:{tag}", t[n]) for n, tag in (("rounding_amount", "RoundingAmount"), ("gross_total", "GrandTotalAmount"), ("prepaid_amount", "TotalPrepaidAmount"), ("payable_amount", "DuePayableAmount"))]]
    settlement = _full(
        "ram:ApplicableHeaderTradeSettlement", _leaf("ram:CreditorReferenceID", p["creditor_id"]), _leaf("ram:PaymentReference", p["payment_reference"]), _leaf("ram:InvoiceCurrencyCode", c("currency")), means, _many(c("vat_breakdown"), group),
        _full("ram:BillingSpecifiedPeriod", _stamp("ram:StartDateTime", c("billing_period_start")), _stamp("ram:EndDateTime", c("billing_period_end"))), _many(c("allowances"), _cii_adjustment_xml(False, True)), _many(c("charges"), _cii_adjustment_xml(True, True)),
        _full("ram:SpecifiedTradePaymentTerms", _leaf("ram:Description", _terms(p), _has_terms(p)), _stamp("ram:DueDateDateTime", p["due_date"]), _leaf("ram:DirectDebitMandateID", p["mandate_reference"])), _full("ram:SpecifiedTradeSettlementHeaderMonetarySummation", *summed),
        _full("ram:InvoiceReferencedDocument", _leaf("ram:IssuerAssignedID", c("preceding_invoice_number")), _stamp("ram:FormattedIssueDateTime", c("preceding_invoice_date"), "qdt")),
    )
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rsm:CrossIndustryInvoice {head}><rsm:ExchangedDocumentContext><ram:GuidelineSpecifiedDocumentContextParameter><ram:ID>{URN["CII"]}</ram:ID></ram:GuidelineSpecifiedDocumentContextParameter></rsm:ExchangedDocumentContext>'),
        _full("rsm:ExchangedDocument", _leaf("ram:ID", c("invoice_number")), _leaf("ram:TypeCode", c("type_code")), _stamp("ram:IssueDateTime", c("issue_date")), _many(c("notes"), lambda n: _full("ram:IncludedNote", _leaf("ram:Content", n)))).text,
        _full("rsm:SupplyChainTradeTransaction", _many(c("lines"), line), agreement, delivery, settlement, _always("")).text, F.lit("</rsm:CrossIndustryInvoice>"),
    )


def to_cii(invoices: DataFrame) -> DataFrame:
    """doc_id, xml. invoices: doc_id and FIELDS."""
    return invoices.select("doc_id", cii().alias("xml"))


def _ubl_address_xml(tag: str, a: Column) -> _Xml:
    return _full(
        tag, _leaf("cbc:StreetName", a["street"]), _leaf("cbc:AdditionalStreetName", a["additional_street"]), _leaf("cbc:CityName", a["city"]), _leaf("cbc:PostalZone", a["postcode"]), _leaf("cbc:CountrySubentity", a["country_subdivision"]),
        _full("cac:AddressLine", _leaf("cbc:Line", a["address_line_3"])), _full("cac:Country", _leaf("cbc:IdentificationCode", a["country"])),
    )


def _ubl_party_xml(tag: str, p: Column, seller: bool, creditor_id: Column | None = None) -> _Xml:
    known = lambda value, **scheme: _full("cac:PartyIdentification", _leaf("cbc:ID", value, **scheme))
    number = lambda value, scheme: _full("cac:PartyTaxScheme", _leaf("cbc:CompanyID", value), _always(f"<cac:TaxScheme><cbc:ID>{scheme}</cbc:ID></cac:TaxScheme>").when(value.isNotNull()))
    register = p["legal"]["commercial_register"] if seller else p["legal_registration_id"]
    c = p["contact"]
    return _full(tag, _full(
        "cac:Party", _leaf("cbc:EndpointID", p["electronic_address"], schemeID=p["electronic_address_scheme"]), known(p["id"]), known(p["global_id"], schemeID="0088"), *([known(creditor_id, schemeID="SEPA")] if creditor_id is not None else []),
        *([_full("cac:PartyName", _leaf("cbc:Name", p["trading_name"]))] if seller else []), _ubl_address_xml("cac:PostalAddress", p["address"]), number(p["vat_id"], "VAT"), *([number(p["tax_number"], "FC")] if seller else []),
        _full("cac:PartyLegalEntity", _leaf("cbc:RegistrationName", p["name"]), _leaf("cbc:CompanyID", register), *([_leaf("cbc:CompanyLegalForm", p["legal"]["additional_info"])] if seller else [])),
        _full("cac:Contact", _leaf("cbc:Name", c["name"]), _leaf("cbc:Telephone", c["phone"]), _leaf("cbc:ElectronicMail", c["email"])),
    ))


def ubl() -> Column:
    """The document of an invoice with FIELDS: an Invoice, or a CreditNote for type code 381."""
    c = F.col
    p, t, buyer = c("payment"), c("totals"), c("buyer")
    money = lambda tag, value: _leaf(f"cbc:{tag}", value, currencyID=c("currency"))
    scheme = _always("<cac:TaxScheme><cbc:ID>VAT</cbc:ID></cac:TaxScheme>")

    def adjustment(charge: bool, taxed: bool):
        def made(x: Column) -> _Xml:
            tax = [_full("cac:TaxCategory", _leaf("cbc:ID", x["vat_category"]), _leaf("cbc:Percent", x["vat_rate"]).when(_rated(x["vat_category"])), scheme)] if taxed else []
            return _full("cac:AllowanceCharge", _always(f"<cbc:ChargeIndicator>{str(charge).lower()}</cbc:ChargeIndicator>"), _leaf("cbc:AllowanceChargeReasonCode", x["reason_code"]), _leaf("cbc:AllowanceChargeReason", x["reason"]), _leaf("cbc:MultiplierFactorNumeric", x["percent"]), money("Amount", x["amount"]), money("BaseAmount", x["base_amount"]), *tax)

        return made

    def line(tag: str, quantity: str):
        def made(i: Column) -> _Xml:
            item = _full(
                "cac:Item", _leaf("cbc:Description", i["item_description"]), _leaf("cbc:Name", i["description"]), _full("cac:BuyersItemIdentification", _leaf("cbc:ID", i["buyer_article_number"])), _full("cac:SellersItemIdentification", _leaf("cbc:ID", i["seller_article_number"])),
                _full("cac:StandardItemIdentification", _leaf("cbc:ID", i["gtin"], schemeID="0160")), _full("cac:ClassifiedTaxCategory", _leaf("cbc:ID", i["vat_category"]), _leaf("cbc:Percent", i["vat_rate"]).when(_rated(i["vat_category"])), scheme),
            )
            price = _full("cac:Price", money("PriceAmount", i["net_price"]), _leaf("cbc:BaseQuantity", i["price_base_quantity"], unitCode=i["unit"]), _full("cac:AllowanceCharge", money("BaseAmount", i["gross_price"])))
            return _full(f"cac:{tag}", _leaf("cbc:ID", i["position"]), _leaf("cbc:Note", i["note"]), _leaf(f"cbc:{quantity}", i["quantity"], unitCode=i["unit"]), money("LineExtensionAmount", i["line_net_amount"]), _many(i["allowances"], adjustment(False, False)), _many(i["charges"], adjustment(True, False)), item, price)

        return made

    def group(g: Column) -> _Xml:
        category = _full("cac:TaxCategory", _leaf("cbc:ID", g["category"]), _leaf("cbc:Percent", g["rate"]).when(_rated(g["category"])), _leaf("cbc:TaxExemptionReasonCode", g["exemption_reason_code"]), _leaf("cbc:TaxExemptionReason", g["exemption_reason"]), scheme)
        return _full("cac:TaxSubtotal", money("TaxableAmount", g["basis_amount"]), money("TaxAmount", g["tax_amount"]), category)

    credit = F.coalesce(c("type_code") == "381", F.lit(False))
    note = lambda yes, no: F.when(credit, F.lit(yes)).otherwise(F.lit(no))
    name = note("CreditNote", "Invoice")
    means = _full("cac:PaymentMeans", _leaf("cbc:PaymentMeansCode", p["means_code"]), _leaf("cbc:PaymentID", p["payment_reference"]), _full("cac:PayeeFinancialAccount", _leaf("cbc:ID", p["iban"]), _leaf("cbc:Name", p["account_name"]), _full("cac:FinancialInstitutionBranch", _leaf("cbc:ID", p["bic"]))), _full("cac:PaymentMandate", _leaf("cbc:ID", p["mandate_reference"]), _full("cac:PayerFinancialAccount", _leaf("cbc:ID", p["debtor_iban"]))))
    inside = [
        _leaf("cbc:ID", c("invoice_number")), _leaf("cbc:IssueDate", c("issue_date")), _leaf("cbc:DueDate", p["due_date"]), _leaf("cbc:CreditNoteTypeCode", c("type_code")).when(credit), _leaf("cbc:InvoiceTypeCode", c("type_code")).when(~credit), _many(c("notes"), lambda n: _leaf("cbc:Note", n)),
        _leaf("cbc:DocumentCurrencyCode", c("currency")), _leaf("cbc:BuyerReference", buyer["buyer_reference"]), _full("cac:InvoicePeriod", _leaf("cbc:StartDate", c("billing_period_start")), _leaf("cbc:EndDate", c("billing_period_end"))), _full("cac:OrderReference", _leaf("cbc:ID", c("order_reference"))),
        _full("cac:BillingReference", _full("cac:InvoiceDocumentReference", _leaf("cbc:ID", c("preceding_invoice_number")), _leaf("cbc:IssueDate", c("preceding_invoice_date")))), _full("cac:ContractDocumentReference", _leaf("cbc:ID", c("contract_reference"))),
        _ubl_party_xml("cac:AccountingSupplierParty", c("seller"), True, p["creditor_id"]), _ubl_party_xml("cac:AccountingCustomerParty", buyer, False),
        _full("cac:Delivery", _leaf("cbc:ActualDeliveryDate", c("delivery_date")), _full("cac:DeliveryLocation", _ubl_address_xml("cac:Address", c("delivery_address"))), _full("cac:DeliveryParty", _full("cac:PartyName", _leaf("cbc:Name", c("delivery_name"))))),
        means, _full("cac:PaymentTerms", _leaf("cbc:Note", _terms(p), _has_terms(p))), _many(c("allowances"), adjustment(False, True)), _many(c("charges"), adjustment(True, True)), _full("cac:TaxTotal", money("TaxAmount", t["vat_total"]), _many(c("vat_breakdown"), group)),
        _full("cac:LegalMonetaryTotal", *[money(tag, t[n]) for n, tag in (("line_total", "LineExtensionAmount"), ("net_total", "TaxExclusiveAmount"), ("gross_total", "TaxInclusiveAmount"), ("allowances", "AllowanceTotalAmount"), ("charges", "ChargeTotalAmount"), ("prepaid_amount", "PrepaidAmount"), ("rounding_amount", "PayableRoundingAmount"), ("payable_amount", "PayableAmount"))]),
        _many(c("lines"), line("CreditNoteLine", "CreditedQuantity")).when(credit), _many(c("lines"), line("InvoiceLine", "InvoicedQuantity")).when(~credit),
    ]
    urn = "urn:oasis:names:specification:ubl:schema:xsd"
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><ubl:'), name, F.lit(f' xmlns:ubl="{urn}:'), name, F.lit(f'-2" xmlns:cac="{urn}:CommonAggregateComponents-2" xmlns:cbc="{urn}:CommonBasicComponents-2"><cbc:CustomizationID>{URN["UBL"]}</cbc:CustomizationID>'),
        *[x.text for x in inside], F.lit("</ubl:"), name, F.lit(">"),
    )


def to_ubl(invoices: DataFrame) -> DataFrame:
    """doc_id, xml. invoices: doc_id and FIELDS."""
    return invoices.select("doc_id", ubl().alias("xml"))

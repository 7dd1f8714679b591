"""The flat invoice form, the checks of single fields and their paths, and invoices filled from their calculation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import checks, currency

#: names of countries and their codes (fixed values)
COUNTRY_NAMES = {
    "deutschland": "DE", "germany": "DE", "österreich": "AT", "oesterreich": "AT", "austria": "AT", "schweiz": "CH", "switzerland": "CH", "frankreich": "FR", "france": "FR", "niederlande": "NL",
    "netherlands": "NL", "belgien": "BE", "belgium": "BE", "luxemburg": "LU", "luxembourg": "LU", "italien": "IT", "italy": "IT", "spanien": "ES", "spain": "ES", "polen": "PL", "poland": "PL",
    "dänemark": "DK", "denmark": "DK", "tschechien": "CZ", "czechia": "CZ",
}
#: invoice type codes (fixed values)
TYPE_CODES = """
71 80 81 82 83 84 102 130 202 203 204 211 218 219 261 262 295 296 308 325 326 331 380 381 382 383 384 385 386 387
388 389 390 393 394 395 396 420 456 457 458 527 532 553 575 623 633 751 780 817 870 875 876 877 935
""".split()
#: field: rule where it is missing (fixed values)
MISSING = {
    "invoice_number": "BR-02", "issue_date": "BR-03", "type_code": "BR-04", "currency": "BR-05", "seller.name": "BR-06", "buyer.name": "BR-07", "seller.address": "BR-08", "seller.address.country": "BR-09",
    "buyer.address": "BR-10", "buyer.address.country": "BR-11", "lines": "BR-16", "lines[].position": "BR-21", "lines[].quantity": "BR-22", "lines[].unit": "BR-23", "lines[].line_net_amount": "BR-24",
    "lines[].description": "BR-25", "lines[].net_price": "BR-26", "lines[].vat_category": "BR-CO-4",
}
#: field: rule where it is wrong (fixed values)
WRONG = {
    "type_code": "BR-CL-01", "currency": "BR-CL-04", "seller.address.country": "BR-CL-14", "buyer.address.country": "BR-CL-14", "lines[].net_price": "BR-27", "lines[].gross_price": "BR-28", "lines[].unit": "BR-CL-23",
}
#: VAT categories without tax and the prefixes of their rules (fixed values)
ZERO_RATED = {"Z": "Z", "E": "E", "AE": "AE", "K": "IC", "G": "G", "O": "O"}
#: a path's pattern and the flat form's field, the first that fits (fixed values)
FLAT_FIELDS = (
    (r"^seller\.address(\..*)?$", "seller_address"), (r"^buyer\.address(\..*)?$", "buyer_address"), (r"^seller\.vat_id$", "seller_vat_id"), (r"^seller\.tax_number$", "seller_tax_number"),
    (r"^seller\.name$", "seller_name"), (r"^buyer\.name$", "buyer_name"), (r"^buyer\.buyer_reference$", "routing_id"), (r"^seller\.contact\.name$", "seller_contact_name"),
    (r"^seller\.contact\.phone$", "seller_phone"), (r"^seller\.contact\.email$|^seller\.electronic_address$", "seller_email"), (r"^seller\.contact$", "seller_contact_name"),
    (r"^buyer\.electronic_address$", "buyer_email"), (r"^payment\.iban$|^payment$", "iban"), (r"^payment\.bic$", "bic"), (r"^payment\.due_date$", "due_date"),
    (r"^totals\.net_total$", "tax_basis_total"), (r"^totals\.vat_total$", "tax_total"), (r"^totals\.gross_total$|^totals\.payable_amount$", "grand_total"),
    (r"^lines\[(\d+)\]\.description$", "line_items[$1].item_description"), (r"^lines\[(\d+)\]\.vat_rate$", "line_items[$1].tax_rate"), (r"^lines\[(\d+)\]", "line_items[$1]"),
)
#: name of an embedded file and the version it tells (fixed values)
VERSIONS = {
    "factur-x.xml": "ZUGFeRD 2.1+ / Factur-X 1.0", "zugferd-invoice.xml": "ZUGFeRD 2.0", "ZUGFeRD-invoice.xml": "ZUGFeRD 1.0", "xrechnung.xml": "ZUGFeRD 2.1+ (XRECHNUNG profile)",
}
ADDRESS_HELP = "Expected 'Street No, Postcode City, Country' (e.g. 'Lieferantenstraße 20, 80333 München, DE')"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def country_codes(spark: SparkSession) -> list[str]:
    """ISO 3166-1 codes of two letters, as the session's Java has them."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def parsed_address(text: Column, countries: list[str]) -> Column:
    """street, additional_street, postcode, city, country of 'Street 1, 12345 City, Country'; null where it is none.

    The country may lack (DE); the first part after the street that is a postcode with a city counts, later parts are left out.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\n]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    country = F.when(F.upper(last).isin(countries), F.upper(last)).otherwise(F.try_element_at(_map(COUNTRY_NAMES), F.lower(last)))
    body = F.when(country.isNotNull(), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    town = r"^(?:[A-Z]{1,2}-)?([0-9]{4,5})\s+(.+)$"
    places = F.filter(F.transform(body, lambda p, i: F.when(p.rlike(town) & (i > 0), i)), lambda i: i.isNotNull())
    at = F.try_element_at(places, F.lit(1))
    found = F.try_element_at(body, at + 1)
    return F.when(at.isNotNull(), F.struct(
        F.try_element_at(body, F.lit(1)).alias("street"), F.nullif(F.array_join(F.slice(body, 2, at - 1), ", "), F.lit("")).alias("additional_street"),
        F.regexp_extract(found, town, 1).alias("postcode"), F.regexp_extract(found, town, 2).alias("city"), F.coalesce(country, F.lit("DE")).alias("country"),
    ))


def is_means_code(value: Column) -> Column:
    return F.coalesce(value.rlike("^([1-9][0-9]?|ZZZ)$"), F.lit(False))


def means_code(given: Column, iban: Column, debtor_iban: Column) -> Column:
    """The payment means: as given, else a transfer (58), a direct debit (59) or undefined (1)."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.coalesce(given, F.when(full(iban), "58").when(full(debtor_iban), "59").otherwise("1"))


def version_text(syntax: Column, profile: Column, xrechnung: Column, embedded: Column, xmp: Column) -> Column:
    """What a document calls its version: by profile, embedded file name and syntax."""
    base = F.concat_ws(" ", F.lit("XRechnung"), F.nullif(xrechnung, F.lit("")))
    inside = F.coalesce(F.try_element_at(_map(VERSIONS), embedded), F.lit("ZUGFeRD 2.x"))
    own = F.coalesce(F.concat(inside, F.lit(" (XMP version "), F.nullif(xmp, F.lit("")), F.lit(")")), inside)
    some = F.coalesce(embedded, F.lit("")) != ""
    return (
        F.when((profile == "XRECHNUNG") & some, F.concat(base, F.lit(" in "), inside)).when(profile == "XRECHNUNG", F.concat(base, F.lit(" ("), syntax, F.lit(")"))).when(some, own)
        .when(syntax == "CII", "ZUGFeRD 2.x / Factur-X 1.0 (CII D16B)").when(syntax == "ZUGFeRD-1.0", "ZUGFeRD 1.0").when(syntax == "UBL", "UBL 2.1")
    )


def flat_field(path: Column) -> Column:
    """The flat form's field of an invoice's path, after "invoice_data."; null and empty stay."""
    bare = F.regexp_replace(path, r"^invoice_data\.", "")
    name = bare
    for pattern, field in reversed(FLAT_FIELDS):
        name = F.when(bare.rlike(pattern), F.regexp_replace(bare, pattern, field)).otherwise(name)
    return F.when(path != "", F.concat(F.lit("invoice_data."), name)).otherwise(path)


def rule_of(path: Column, kind: Column, message: Column) -> Column:
    """The rule an error belongs to: by its path without places, else as its text names it, else SCHEMA. kind: missing or another."""
    generic = F.regexp_replace(path, r"\[[0-9]+\]", "[]")
    known = F.when(kind == "missing", F.try_element_at(_map(MISSING), generic)).otherwise(F.try_element_at(_map(WRONG), generic))
    return F.coalesce(known, F.nullif(F.regexp_extract(F.coalesce(message, F.lit("")), r"\((BR-[A-Z0-9-]+)\)", 1), F.lit("")), F.lit("SCHEMA"))


def _checked(rows: DataFrame, place: list, found: list[tuple[Column, Column | str, Column]]) -> DataFrame:
    """inv_id, rule_id, field, message of the conditions that hold. found: condition, path, message."""
    struct = lambda path, message: F.struct((F.lit(path) if isinstance(path, str) else path).alias("field"), message.alias("message"))
    made = F.filter(F.array(*[F.when(c, struct(p, m)) for c, p, m in found]), lambda x: x.isNotNull())
    return rows.select("inv_id", *place, F.explode(made).alias("x")).select("inv_id", rule_of(F.col("x.field"), F.lit("value"), F.col("x.message")).alias("rule_id"), "x.field", "x.message")


def field_issues(headers: DataFrame, countries: list[str]) -> DataFrame:
    """inv_id, rule_id, field, message of header fields that are no such values; empty optional fields pass.

    headers: inv_id, type_code, currency, billing_period_start, billing_period_end, means_code, iban, debtor_iban, bic,
    discount_days, discount_percent, is_xrechnung and, for seller_ and buyer_, country, email, vat_id, global_id,
    electronic_address, electronic_address_scheme. routing_id only where the form has it.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    quoted = lambda c: say("'", F.coalesce(F.col(c), F.lit("")), "'")
    upper = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    found = [
        (~F.trim(F.coalesce("type_code", F.lit(""))).isin(TYPE_CODES), "type_code", say(quoted("type_code"), " is not an EN 16931 invoice type code (BR-CL-01)")),
        (~upper("currency").isin(currency.CODES), "currency", say(quoted("currency"), " is not an ISO 4217 currency code (BR-CL-04)")),
    ]
    for side in ("seller", "buyer"):
        vat, address = checks.compact(F.col(f"{side}_vat_id")), F.col(f"{side}_electronic_address")
        origin = F.substring(vat, 1, 2).isin([*countries, "EL"])
        leitweg = checks.leitweg_ok(address).isNotNull()
        found += [
            (~upper(f"{side}_country").isin(countries), f"{side}.address.country", say(quoted(f"{side}_country"), " is not an ISO 3166-1 alpha-2 country code (BR-CL-14)")),
            (full(f"{side}_email") & ~F.col(f"{side}_email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), f"{side}.contact.email", F.lit("Invalid email address")),
            (full(f"{side}_global_id") & ~checks.gtin_ok(F.col(f"{side}_global_id")), f"{side}.global_id", F.lit("Global ID must be a valid 13-digit GLN (GS1 check digit failed)")),
            (full(f"{side}_vat_id") & ~origin, f"{side}.vat_id", F.lit("VAT identifier must start with an ISO 3166-1 country code (BR-CO-9)")),
            (full(f"{side}_vat_id") & origin & ~checks.vat_id_ok(vat), f"{side}.vat_id", F.lit("Invalid VAT identifier format (German USt-IdNr.: 'DE' + 9 digits)")),
            (full(f"{side}_electronic_address") & ~full(f"{side}_electronic_address_scheme") & ~address.contains("@") & ~leitweg, side, F.lit("electronic_address_scheme is required when the electronic address is not an email or Leitweg-ID")),
        ]
    found += [
        (F.col("means_code").isNotNull() & ~is_means_code(F.col("means_code")), "payment.means_code", say(quoted("means_code"), " is not a UNTDID 4461 payment means code (BR-CL-16)")),
        *[(full(c) & ~checks.iban_ok(F.col(c)), f"payment.{c}", F.lit("Invalid IBAN (checksum failed) (BR-DE-19)")) for c in ("iban", "debtor_iban")],
        (full("bic") & ~checks.bic_ok(F.col("bic")), "payment.bic", F.lit("Invalid BIC format")),
        (F.col("discount_days").isNull() != F.col("discount_percent").isNull(), "payment", F.lit("discount_days and discount_percent must be given together")),
        (F.col("billing_period_end") < F.col("billing_period_start"), "", F.lit("billing_period_end must not be before billing_period_start")),
    ]
    if "routing_id" in headers.columns:
        found.append((F.col("is_xrechnung") & ~(F.trim(F.coalesce("routing_id", F.lit(""))) != ""), "routing_id", F.lit("routing_id (Leitweg-ID) is mandatory when format_type is XRechnung (BR-DE-15)")))
    return _checked(headers, [], found)


def line_field_issues(lines: DataFrame) -> DataFrame:
    """inv_id, rule_id, field, message of lines. lines: inv_id, idx (from 0), position, unit, gtin, quantity, vat_category, vat_rate, net_price, gross_price.

    Of a line's quantity, rate and price only the first fault is told. A position that an earlier line of the invoice has, or that
    a line without one gets by its place, is a fault of the invoice, told once by that text.
    """
    at = lambda name: F.concat(F.lit("lines["), F.col("idx").cast("string"), F.lit(f"]{name}"))
    zero, rate = F.col("vat_category").isin(*ZERO_RATED), F.col("vat_rate")
    whole = (
        F.when(F.col("quantity") == 0, "quantity must not be 0 (BR-22)")
        .when(zero & (rate != 0), F.concat(F.lit("VAT rate must be 0 for category "), F.col("vat_category")))
        .when((F.col("vat_category") == "S") & (rate <= 0), "VAT rate must be greater than 0 for category S (BR-S-05)")
        .when(F.col("gross_price") < F.col("net_price"), "gross_price must be greater than or equal to net_price (net = gross − price discount)")
    )
    single = _checked(lines, ["idx"], [
        (checks.unit_code(F.col("unit")).isNull(), at(".unit"), F.concat(F.lit("Unknown unit '"), F.coalesce("unit", F.lit("")), F.lit("'. Use a UN/ECE Rec 20 code (C62, HUR, KGM …) or an alias like 'Stk'"))),
        ((F.coalesce("gtin", F.lit("")) != "") & ~checks.gtin_ok(F.col("gtin")), at(".gtin"), F.lit("GTIN check digit is invalid")),
        (whole.isNotNull(), at(""), whole),
    ])
    placed = lines.select("inv_id", F.coalesce(F.nullif("position", F.lit("")), (F.col("idx") + 1).cast("string")).alias("position"))
    twice = placed.groupBy("inv_id", "position").count().where("count > 1")
    return single.unionByName(twice.select("inv_id", F.lit("SCHEMA").alias("rule_id"), F.lit("").alias("field"), F.concat(F.lit("Duplicate line position '"), "position", F.lit("'")).alias("message")))


def adjustment_issues(adjustments: DataFrame) -> DataFrame:
    """inv_id, rule_id, field, message of allowances and charges. adjustments: inv_id, path, reason, reason_code, of_line, vat_category, vat_rate."""
    rate, category = F.col("vat_rate"), F.col("vat_category")
    none = (F.coalesce("reason", F.lit("")) == "") & (F.coalesce("reason_code", F.lit("")) == "")
    message = (
        F.when(none, F.when(F.col("of_line"), "reason or reason_code is required (BR-42 / BR-44)").otherwise("reason or reason_code is required (BR-33 / BR-38)"))
        .when(F.col("of_line"), F.lit(None).cast("string"))
        .when(category.isin(*ZERO_RATED) & (rate != 0), F.concat(F.lit("VAT rate must be 0 for category "), category, F.lit(" (BR-"), F.try_element_at(_map(ZERO_RATED), category), F.lit("-06/07)")))
        .when((category == "S") & (rate <= 0), "VAT rate must be greater than 0 for category S (BR-S-06/07)")
    )
    return _checked(adjustments, [], [(message.isNotNull(), F.col("path"), message)])


def from_flat(forms: DataFrame, countries: list[str]) -> tuple[DataFrame, DataFrame]:
    """Invoices of flat forms (nested as the XML reader's) and their issues: (invoices, issues).

    forms: inv_id, invoice_number, issue_date, currency, delivery_date, seller_name, seller_address, seller_vat_id, seller_tax_number,
    seller_contact_name, seller_phone, seller_email, buyer_name, buyer_address, buyer_email, routing_id, payment_terms, due_date, iban,
    bic, tax_basis_total, tax_total, grand_total, line_items: array of (item_description, net_price, quantity, unit, tax_rate, line_net_amount).
    A form with an issue has no invoice; of its faults the first is told: a line at 0 %, the seller's address, the buyer's.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    typed = forms.withColumns({"seller_at": parsed_address(F.col("seller_address"), countries), "buyer_at": parsed_address(F.col("buyer_address"), countries)})
    free = F.filter(F.transform("line_items", lambda x, i: F.when(x["tax_rate"] == 0, i)), lambda i: i.isNotNull())
    issue = lambda rule, field, message: F.struct(F.lit(rule).alias("rule_id"), F.concat(F.lit("invoice_data."), field).alias("field"), F.lit(message).alias("message"))
    of_line = F.concat(F.lit("line_items["), F.try_element_at(free, F.lit(1)).cast("string"), F.lit("].tax_rate"))
    fault = (
        F.when(F.size(free) > 0, issue("VAT-CATEGORY", of_line, "0 % lines need a VAT category and exemption reason; use /api/einvoice/create-zugferd or /create-xrechnung"))
        .when(F.col("seller_at").isNull(), issue("ADDRESS", F.lit("seller_address"), ADDRESS_HELP))
        .when(F.col("buyer_at").isNull(), issue("ADDRESS", F.lit("buyer_address"), ADDRESS_HELP))
    )
    typed = typed.withColumn("fault", fault)
    lines = F.transform("line_items", lambda x: F.struct(
        x["item_description"].alias("description"), x["net_price"].alias("net_price"), x["quantity"].alias("quantity"), x["unit"].alias("unit"), F.lit("S").alias("vat_category"),
        x["tax_rate"].alias("vat_rate"), x["line_net_amount"].alias("line_net_amount"),
    ))
    contact = F.when(full("seller_contact_name") | full("seller_phone") | full("seller_email"), F.struct(F.col("seller_contact_name").alias("name"), F.col("seller_phone").alias("phone"), F.col("seller_email").alias("email")))
    pays = full("payment_terms") | full("iban") | F.col("due_date").isNotNull()
    payment = F.when(pays, F.struct(F.when(full("iban"), "58").otherwise("1").alias("means_code"), F.col("payment_terms").alias("terms"), F.col("due_date").alias("due_date"), F.col("iban").alias("iban"), F.col("bic").alias("bic")))
    party = lambda side, *more: F.struct(F.col(f"{side}_name").alias("name"), F.col(f"{side}_at").alias("address"), F.col(f"{side}_email").alias("electronic_address"), *more)
    invoices = typed.where("fault is null").select(
        "inv_id", "invoice_number", "issue_date", "currency", "delivery_date",
        party("seller", F.col("seller_vat_id").alias("vat_id"), F.col("seller_tax_number").alias("tax_number"), contact.alias("contact")).alias("seller"),
        party("buyer", F.col("routing_id").alias("buyer_reference")).alias("buyer"), lines.alias("lines"),
        F.struct(F.col("tax_basis_total").alias("net_total"), F.col("tax_total").alias("vat_total"), F.col("grand_total").alias("gross_total")).alias("totals"), payment.alias("payment"),
    )
    return invoices, typed.where("fault is not null").select("inv_id", "fault.*")


def completed(lines: DataFrame, breakdown: DataFrame, totals: DataFrame) -> DataFrame:
    """inv_id, lines (idx, line_net_amount), vat_breakdown (vat_category, vat_rate, basis, tax in order of appearance), totals, all calculated.

    lines: einvoice.calculated_lines(); breakdown: einvoice.vat_breakdown(); totals: einvoice.document_totals().
    """
    of_lines = lines.groupBy("inv_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("amount").cast("decimal(19,2)").alias("line_net_amount")))).alias("lines"))
    group = F.struct("seq", "vat_category", "vat_rate", "basis", "tax")
    groups = breakdown.groupBy("inv_id").agg(F.transform(F.sort_array(F.collect_list(group)), lambda g: g.dropFields("seq")).alias("vat_breakdown"))
    sums = totals.select("inv_id", F.struct(*[c for c in totals.columns if c != "inv_id"]).alias("totals"))
    return of_lines.join(groups, "inv_id", "left").join(sums, "inv_id", "left")

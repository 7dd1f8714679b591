"""Recalculation and rules of structured e-invoices, many invoices in one plan.

lines: inv_id, idx, quantity, net_price, base_quantity, vat_category, vat_rate, allowance, charge, line_net_amount (declared, or null)
adjustments (document level): inv_id, is_charge, amount, vat_category, vat_rate
declared_vat: inv_id, vat_category, vat_rate, basis_amount, tax_amount, exemption_reason
declared_totals: inv_id and TOTALS columns, prepaid_amount, rounding_amount (null where not declared)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import checks

AMOUNT = "decimal(19,2)"
#: VAT category: prefix in rule ids (fixed values)
PREFIXES = {"S": "S", "Z": "Z", "E": "E", "AE": "AE", "K": "IC", "G": "G", "O": "O", "L": "AF", "M": "AG"}
#: categories that need an exemption reason (fixed values)
NEEDS_REASON = ("E", "AE", "K", "G", "O")
#: total: rule that compares it (fixed values)
TOTALS = {"line_total": "BR-CO-10", "allowances": "BR-CO-11", "charges": "BR-CO-12", "net_total": "BR-CO-13", "vat_total": "BR-CO-14", "gross_total": "BR-CO-15", "payable_amount": "BR-CO-16"}
ISSUE = ("inv_id", "rule_id", "field", "severity", "expected", "actual")


def cents(x: Column) -> Column:
    return F.round(x, 2).cast(AMOUNT)


def line_net(quantity: Column, price: Column, base: Column, allowance: Column, charge: Column) -> Column:
    """round(quantity * price / base quantity) - allowances + charges."""
    product = quantity.cast("decimal(18,6)") * price.cast("decimal(18,6)")
    ratio = product / F.coalesce(base, F.lit(1)).cast("decimal(12,4)")
    return (cents(ratio) - F.coalesce(allowance, F.lit(0)) + F.coalesce(charge, F.lit(0))).cast(AMOUNT)


def calculated_lines(lines: DataFrame) -> DataFrame:
    computed = line_net(*[F.col(c) for c in ("quantity", "net_price", "base_quantity", "allowance", "charge")])
    return lines.withColumn("computed", computed).withColumn("amount", F.coalesce("line_net_amount", "computed"))


def line_issues(lines: DataFrame) -> DataFrame:
    wrong = calculated_lines(lines).where("line_net_amount is not null and line_net_amount != computed")
    return wrong.select(
        "inv_id", F.lit("CALC-LINE-NET").alias("rule_id"), F.format_string("lines[%d].line_net_amount", F.col("idx").cast("int")).alias("field"),
        F.lit("error").alias("severity"), F.col("computed").cast("string").alias("expected"), F.col("line_net_amount").cast(AMOUNT).cast("string").alias("actual"),
    )


def vat_breakdown(lines: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Basis and tax for each category and rate, with the place of its first appearance."""
    of_lines = calculated_lines(lines).select("inv_id", "vat_category", "vat_rate", F.col("amount").cast(AMOUNT).alias("amount"), F.col("idx").cast("bigint").alias("seq"))
    of_document = adjustments.select(
        "inv_id", "vat_category", "vat_rate", F.when(F.col("is_charge"), F.col("amount")).otherwise(-F.col("amount")).cast(AMOUNT).alias("amount"),
        F.when(F.col("is_charge"), 1 << 40).otherwise(1 << 41).cast("bigint").alias("seq"),
    )
    g = of_lines.unionByName(of_document).groupBy("inv_id", "vat_category", "vat_rate").agg(F.sum("amount").alias("basis"), F.min("seq").alias("seq"))
    basis = cents(F.col("basis"))
    return g.select("inv_id", "vat_category", "vat_rate", basis.alias("basis"), cents(basis * F.col("vat_rate") / 100).alias("tax"), "seq")


def _prefix(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for c, p in PREFIXES.items():
        out = F.when(category == c, F.lit(p)).otherwise(out)
    return out


def vat_checked(breakdown: DataFrame, declared: DataFrame) -> DataFrame:
    """Computed and declared groups side by side (full outer)."""
    d = declared.select("inv_id", "vat_category", "vat_rate", F.col("basis_amount").alias("d_basis"), F.col("tax_amount").alias("d_tax"), "exemption_reason", F.lit(True).alias("declared"))
    return breakdown.join(d, ["inv_id", "vat_category", "vat_rate"], "full_outer")


def vat_issues(breakdown: DataFrame, declared: DataFrame) -> DataFrame:
    rule = lambda n: F.concat(F.lit("BR-"), _prefix(F.col("vat_category")), F.lit(f"-{n}"))
    text = lambda c: F.col(c).cast(AMOUNT).cast("string")
    known, said = F.col("basis").isNotNull(), F.coalesce("declared", F.lit(False))
    none = F.lit(None).cast("string")

    def issue(when, rule_id, field, severity, expected=none, actual=none):
        parts = zip(ISSUE[1:], (rule_id, field, severity, expected, actual))
        return F.when(when, F.struct(*[x.alias(n) for n, x in parts]))

    slack = F.when(F.abs(F.col("d_tax") - F.col("tax")) <= F.lit("0.01").cast(AMOUNT), "warning").otherwise("error")
    found = F.array(
        issue(said & ~known, F.lit("BR-CO-18"), F.lit("vat_breakdown"), F.lit("error")),
        issue(said & known & (F.col("d_basis") != F.col("basis")), rule("08"), F.lit("vat_breakdown.basis_amount"), F.lit("error"), text("basis"), text("d_basis")),
        issue(said & known & (F.col("d_tax") != F.col("tax")), rule("09"), F.lit("vat_breakdown.tax_amount"), slack, text("tax"), text("d_tax")),
        issue(known & F.col("vat_category").isin(*NEEDS_REASON) & F.col("exemption_reason").isNull(), rule("10"), F.lit("vat_breakdown"), F.lit("error")),
    )
    kept = F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")
    return vat_checked(breakdown, declared).select("inv_id", kept).select("inv_id", "x.*")


def document_totals(lines: DataFrame, adjustments: DataFrame, breakdown: DataFrame, declared_vat: DataFrame, declared: DataFrame) -> DataFrame:
    """All totals; a declared tax of a group replaces the computed one."""
    base = calculated_lines(lines).groupBy("inv_id").agg(F.sum("amount").alias("line_total"))
    part = lambda charge: F.sum(F.when(F.col("is_charge") == charge, F.col("amount")))
    adjusted = adjustments.groupBy("inv_id").agg(part(False).alias("allowances"), part(True).alias("charges"))
    vat = vat_checked(breakdown, declared_vat).where("basis is not null").groupBy("inv_id").agg(F.sum(F.coalesce("d_tax", "tax")).alias("vat_total"))
    joined = base.join(adjusted, "inv_id", "left").join(vat, "inv_id", "left").join(declared.select("inv_id", "prepaid_amount", "rounding_amount"), "inv_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(29,2)")
    net = zero("line_total") - zero("allowances") + zero("charges")
    gross = net + zero("vat_total")
    payable = gross - zero("prepaid_amount") + zero("rounding_amount")
    values = {"line_total": zero("line_total"), "allowances": zero("allowances"), "charges": zero("charges"), "net_total": net, "vat_total": zero("vat_total"), "gross_total": gross, "payable_amount": payable}
    return joined.select("inv_id", *[v.cast(AMOUNT).alias(k) for k, v in values.items()])


def total_issues(totals: DataFrame, declared: DataFrame) -> DataFrame:
    """A row for each declared total that differs from the computed one."""
    side = lambda df, letter: df.select("inv_id", *[F.col(t).cast(AMOUNT).alias(f"{letter}_{t}") for t in TOTALS])
    # whole invoices are joined, and what differs is told apart afterwards
    both = side(totals, "c").join(side(declared, "d"), "inv_id")
    told = lambda t, rule: F.struct(F.lit(rule).alias("rule_id"), F.lit(f"totals.{t}").alias("field"), F.lit("error").alias("severity"), F.col(f"c_{t}").cast("string").alias("expected"), F.col(f"d_{t}").cast("string").alias("actual"))
    found = F.array(*[F.when(F.col(f"d_{t}") != F.col(f"c_{t}"), told(t, rule)) for t, rule in TOTALS.items()])
    return both.select("inv_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("inv_id", "x.*")


def _missing(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _none_of(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & _missing(c)
    return out


def header_issues(headers: DataFrame) -> DataFrame:
    """Party, payment, address and German rules. headers: one row per invoice with
    categories array<string>, seller_*, buyer_* and delivery_* columns, payment and date columns, is_xrechnung.
    A contact, delivery address or payment is given where any of its columns is."""
    has = lambda c: F.array_contains("categories", c)
    unregistered = _missing("seller_vat_id") & _missing("seller_tax_number")
    x = F.col("is_xrechnung")
    rules = [(has(c) & unregistered, r, "seller.vat_id", F.lit("error")) for c, r in (("S", "BR-S-02"), ("Z", "BR-Z-02"), ("E", "BR-E-02"), ("L", "BR-AF-02"), ("M", "BR-AG-02"), ("AE", "BR-AE-02"))]
    uncontacted, unaddressed = _none_of("seller_contact_name", "seller_contact_phone", "seller_contact_email"), _none_of("delivery_street", "delivery_postcode", "delivery_city", "delivery_country")
    unpaid = _none_of("means_code", "iban", "terms", "mandate_reference", "creditor_id", "debtor_iban") & F.col("due_date").isNull()
    debit, leitweg = F.col("means_code").isin("49", "59"), checks.leitweg_ok(F.col("buyer_reference"))
    undelivered = F.col("delivery_date").isNull() & F.col("billing_period_start").isNull()
    error, warning = F.lit("error"), F.lit("warning")
    rules += [
        (has("AE") & _missing("buyer_vat_id") & _missing("buyer_legal_id"), "BR-AE-02", "buyer.vat_id", error),
        (has("K") & _missing("seller_vat_id"), "BR-IC-02", "seller.vat_id", error),
        (has("K") & _missing("buyer_vat_id"), "BR-IC-02", "buyer.vat_id", error),
        (has("K") & undelivered, "BR-IC-11", "delivery_date", error),
        (has("K") & unaddressed, "BR-IC-12", "delivery_address", error),
        (has("G") & _missing("seller_vat_id"), "BR-G-02", "seller.vat_id", error),
        (has("O") & ~(_missing("seller_vat_id") & _missing("buyer_vat_id")), "BR-O-02", "seller.vat_id", error),
        (has("O") & (F.size(F.array_distinct("categories")) > 1), "BR-O-11", "lines", error),
        ((F.col("payable_amount") > 0) & F.col("due_date").isNull() & _missing("terms"), "BR-CO-25", "payment.due_date", error),
        (F.col("means_code").isin("30", "58") & _missing("iban"), "BR-61", "payment.iban", error),
        (F.col("due_date") < F.col("issue_date"), "DE-DUE-DATE", "payment.due_date", warning),
        (_missing("seller_id") & _missing("seller_vat_id"), "BR-CO-26", "seller.vat_id", error),
        (undelivered, "DE-UStG-14-DELIVERY", "delivery_date", warning),
        (F.col("type_code").isin("381", "384") & _missing("preceding_invoice"), "DE-PRECEDING-INVOICE", "preceding_invoice_number", warning),
        (x & ~F.col("type_code").isin("326", "380", "381", "384", "389", "875", "876", "877"), "BR-DE-17", "type_code", error),
        (x & _missing("buyer_reference"), "BR-DE-15", "buyer.buyer_reference", error),
        (x & ~leitweg, "LEITWEG-ID", "buyer.buyer_reference", error),
        (x & ~_missing("buyer_reference") & leitweg.isNull(), "LEITWEG-ID", "buyer.buyer_reference", warning),
        (x & uncontacted, "BR-DE-2", "seller.contact", error),
        (x & ~uncontacted & _missing("seller_contact_name"), "BR-DE-5", "seller.contact.name", error),
        (x & ~uncontacted & _missing("seller_contact_phone"), "BR-DE-6", "seller.contact.phone", error),
        (x & ~uncontacted & _missing("seller_contact_email"), "BR-DE-7", "seller.contact.email", error),
        (x & _missing("seller_electronic_address"), "PEPPOL-EN16931-R020", "seller.electronic_address", error),
        (x & _missing("buyer_electronic_address"), "PEPPOL-EN16931-R010", "buyer.electronic_address", error),
        (x & ~unaddressed & _missing("delivery_city"), "BR-DE-10", "delivery_address.city", error),
        (x & ~unaddressed & _missing("delivery_postcode"), "BR-DE-11", "delivery_address.postcode", error),
        (x & unregistered, "BR-DE-16", "seller.vat_id", error),
        (x & unpaid, "BR-DE-1", "payment", error),
        (x & debit & _missing("mandate_reference"), "SEPA-MANDATE", "payment.mandate_reference", error),
        (x & debit & _missing("creditor_id"), "BR-DE-30", "payment.creditor_id", error),
        (x & debit & _missing("debtor_iban"), "BR-DE-31", "payment.debtor_iban", error),
        (x & F.col("means_code").isin("48", "54", "55"), "BR-DE-24-a", "payment.means_code", error),
    ]
    strict = {("seller", "city"): "BR-DE-3", ("seller", "postcode"): "BR-DE-4", ("buyer", "city"): "BR-DE-8", ("buyer", "postcode"): "BR-DE-9"}
    for role in ("seller", "buyer"):
        by_country = F.when(F.coalesce(F.col(f"{role}_country") == "DE", F.lit(False)), "error").otherwise("warning")
        for part in ("street", "postcode", "city"):
            gone, field = _missing(f"{role}_{part}"), f"{role}.address.{part}"
            if rule := strict.get((role, part)):
                rules += [(gone & x, rule, field, error), (gone & ~x, "DE-UStG-14-ADDRESS", field, by_country)]
            else:
                rules.append((gone, "DE-UStG-14-ADDRESS", field, by_country))
    none = F.lit(None).cast("string")
    made = [F.when(when, F.struct(F.lit(r).alias("rule_id"), F.lit(f).alias("field"), s.alias("severity"), none.alias("expected"), none.alias("actual"))) for when, r, f, s in rules]
    return headers.select("inv_id", F.explode(F.filter(F.array(*made), lambda i: i.isNotNull())).alias("x")).select("inv_id", "x.*")


def percent_issues(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """Allowances and charges that are not base amount * percent / 100, where both are given.

    entries: inv_id, path (allowances[i], charges[i], lines[n].allowances[i] or lines[n].charges[i]), amount, base_amount, percent."""
    expected = cents(F.col("base_amount").cast("decimal(19,4)") * F.col("percent").cast("decimal(12,4)") / 100)
    wrong = entries.withColumn("said", expected).where("said != amount").join(headers.select("inv_id", "is_xrechnung"), "inv_id")
    return wrong.select(
        "inv_id", F.lit("PEPPOL-EN16931-R040").alias("rule_id"), F.concat("path", F.lit(".amount")).alias("field"), F.when(F.col("is_xrechnung"), "error").otherwise("warning").alias("severity"),
        F.col("said").cast("string").alias("expected"), F.col("amount").cast(AMOUNT).cast("string").alias("actual"),
    )


def report(issues: DataFrame, invoices: DataFrame) -> DataFrame:
    """Valid where no error was found: inv_id, valid, errors, warnings."""
    g = issues.groupBy("inv_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    full = invoices.select("inv_id").distinct().join(g, "inv_id", "left").fillna(0, ["errors", "warnings"])
    return full.select("inv_id", (F.col("errors") == 0).alias("valid"), "errors", "warnings")

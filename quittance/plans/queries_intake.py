"""Queries of uploads, statement loading, the flat invoice form and field checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import einvoice, intake, invoice_form
from . import driver_data as data
from .queries_documents import _INVOICES, _adjustments, _breakdown, _declared, _lines, _said

#: invented names and contents of files, by key
_NAMES = ("a.pdf", "Scan.JPG", "book.csv", "book.xlsx", "notes.doc", ".pdf", "", "b.tiff", "c.txt")
_CONTENTS = ("%PDF-1.7", "date;amount\n2026-01-01;1\n", "", "no table", "\\xFF\\xD8\\xFF\\xE0")
_SHEET_TAIL = " file. Upload a CSV, Excel (.xlsx/.xls), PDF or image file."


def _of(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _files(spark, sf):
    k = F.col("p_partkey")
    content = [c.encode() if "\\" not in c else b"\xff\xd8\xff\xe0" for c in _CONTENTS]
    return data.load(spark, sf, "part").select(
        k.cast("string").alias("path"), F.when(k % 2 == 0, "bank_statement").otherwise("business_ledger").alias("role"), _of(_NAMES, k).alias("filename"), _of(content, F.floor(k / len(_NAMES))).alias("content")
    )


def upload_checks(spark: SparkSession, sf: str) -> DataFrame:
    return intake.uploads(_files(spark, sf))


def document_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return intake.document_kinds(_files(spark, sf))


def statement_loading(spark: SparkSession, sf: str) -> DataFrame:
    """Documents made from orders, with every way a statement can be had or fail."""
    o, k = data.load(spark, sf, "orders"), F.col("o_orderkey")
    d = o.select(
        k.alias("doc_id"), F.when(k % 2 == 0, "bank_statement").otherwise("business_ledger").alias("role"), _of(("pdf", "spreadsheet", "image"), k).alias("kind"), _of(("completed", "failed", "completed", "completed", "completed"), k).alias("status"),
        F.when(k % 15 == 1, "File is Encrypted").when(k % 15 == 6, "timeout").alias("error"), F.when(k % 4 == 0, 3).alias("n_rows"), F.when(k % 7 != 0, F.lit(" text ")).otherwise(F.lit(" ")).alias("raw_text"),
        F.when(k % 13 != 0, _of(("ledger", "invoice", "receipt", "letter"), F.floor(k / 4))).alias("triage"), F.when(k % 3 == 0, 1).alias("recovered"), F.when(k % 5 == 0, "a letter").alias("reason"),
    )
    return intake.loaded(d)


def column_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of fields to columns of a sheet five cells wide."""
    k = F.col("c_custkey")
    place = lambda n: (F.floor(k / n) % 7 - 1).cast("int")
    fields = F.create_map(F.lit("date"), place(1), F.when(k % 2 == 0, "amount").otherwise("balance"), place(7))
    return data.load(spark, sf, "customer").select(k.alias("doc_id"), intake.hint_ok(fields, F.lit(5)).alias("ok"))


_CELLS = {"Amount (CAD)": "CAD", "12,50 €": "EUR", "$ 5": None, "1.00": None, "7 EUR": "EUR"}


def sheet_currencies(spark: SparkSession, sf: str) -> DataFrame:
    o = data.load(spark, sf, "orders")
    cells = o.select(F.col("o_custkey").alias("path"), _of(list(_CELLS), F.col("o_orderkey")).alias("cell"))
    return intake.sheet_currencies(cells)


def printed_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals looked up in texts that print them with a comma, with a point, or not at all."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    plain = price.cast("string")
    text = F.concat(F.lit("Total: "), F.when(k % 3 == 0, F.replace(plain, F.lit("."), F.lit(","))).when(k % 3 == 1, F.format_number(price, 2)).otherwise((price + 1).cast("string")), F.lit(" due"))
    return data.load(spark, sf, "orders").select(k.alias("doc_id"), intake.is_printed(price, text).alias("printed"))


_COUNTRIES = ("DE", "Österreich", "fr", "Nowhere", "")


def form_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of customers, some with a second line, a prefix, a country or without a postcode."""
    k = F.col("c_custkey")
    town = F.concat(F.when(k % 3 == 0, "D-").otherwise(""), F.when(k % 7 != 0, F.format_string("%05d ", k % 100_000)).otherwise(""), F.lit("Bad Ort"))
    text = F.concat(F.lit("Weg "), k.cast("string"), F.when(k % 4 == 0, ", Hof 2").otherwise(""), F.lit("\n"), town, F.lit(", "), _of(_COUNTRIES, k))
    at = invoice_form.parsed_address(text, invoice_form.country_codes(spark))
    return data.load(spark, sf, "customer").select(k.alias("inv_id"), at.alias("a")).select("inv_id", "a.*")


def _forms(spark, sf):
    o, k = data.load(spark, sf, "orders"), F.col("o_orderkey")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    item = F.struct(
        F.col("l_linenumber").alias("no"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("item_description"), money("l_extendedprice").alias("net_price"), F.lit(1).cast("decimal(18,4)").alias("quantity"), F.lit("Stk").alias("unit"),
        F.when((F.col("l_orderkey") % 6 == 0) & (F.col("l_linenumber") == 2), 0).otherwise(19).cast("decimal(5,2)").alias("tax_rate"), money("l_extendedprice").alias("line_net_amount"),
    )
    items = data.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("no")).alias("line_items"))
    some = lambda n, value: F.when(k % n == 0, F.lit(value)).otherwise(F.lit(None).cast("string"))
    return o.join(items, "o_orderkey").select(
        k.alias("inv_id"), F.concat(F.lit("R"), k.cast("string")).alias("invoice_number"), F.to_date("o_orderdate").alias("issue_date"), F.lit("EUR").alias("currency"), F.lit(None).cast("date").alias("delivery_date"), F.lit("Seller").alias("seller_name"),
        F.when(k % 5 == 0, "Weg 1").otherwise("Weg 1, 80333 München, DE").alias("seller_address"), F.lit("DE123456789").alias("seller_vat_id"), some(2, "12/345").alias("seller_tax_number"), some(3, "Name").alias("seller_contact_name"),
        some(1 << 40, "").alias("seller_phone"), some(4, "a@example.com").alias("seller_email"), F.lit("Buyer").alias("buyer_name"), F.when(k % 7 == 0, "12345 Ort").otherwise("Weg 2, 1010 Wien, Austria").alias("buyer_address"),
        F.lit(None).cast("string").alias("buyer_email"), F.lit("04011000-1234512345-06").alias("routing_id"), some(8, "net 30").alias("payment_terms"), F.lit(None).cast("date").alias("due_date"), some(9, "DE89370400440532013000").alias("iban"),
        F.lit(None).cast("string").alias("bic"), money("o_totalprice").alias("tax_basis_total"), F.lit(0).cast("decimal(18,2)").alias("tax_total"), money("o_totalprice").alias("grand_total"), "line_items",
    )


def form_invoices(spark: SparkSession, sf: str) -> DataFrame:
    invoices, _ = invoice_form.from_flat(_forms(spark, sf), invoice_form.country_codes(spark))
    return invoices.select(
        "inv_id", "invoice_number", F.col("seller.address.city").alias("seller_city"), F.col("buyer.address.country").alias("buyer_country"), F.col("seller.contact.name").alias("contact_name"), F.col("seller.contact").isNotNull().alias("has_contact"),
        F.col("payment.means_code").alias("means_code"), F.size("lines").cast("bigint").alias("n_lines"), F.element_at("lines", 1)["description"].alias("first_line"), F.col("totals.gross_total").cast("double").alias("gross_total"),
    )


def form_issues(spark: SparkSession, sf: str) -> DataFrame:
    _, issues = invoice_form.from_flat(_forms(spark, sf), invoice_form.country_codes(spark))
    return issues


#: paths and the flat form's names for them
_PATHS = {
    "seller.address.city": "seller_address", "invoice_data.buyer.address": "buyer_address", "buyer.buyer_reference": "routing_id", "seller.electronic_address": "seller_email", "payment": "iban", "payment.terms": "payment.terms",
    "totals.payable_amount": "grand_total", "lines[{k}].description": "line_items[{k}].item_description", "lines[{k}].vat_rate": "line_items[{k}].tax_rate", "lines[{k}].unit": "line_items[{k}].unit", "notes": "notes",
}


def form_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.replace(_of(list(_PATHS), k), F.lit("{k}"), k.cast("string"))
    return data.load(spark, sf, "part").select(k.alias("issue_id"), path.alias("path"), invoice_form.flat_field(path).alias("field"))


#: path, kind and message of errors with the rule each belongs to
_ERRORS = {
    ("invoice_number", "missing", ""): "BR-02", ("lines[12].quantity", "missing", ""): "BR-22", ("lines[3].unit", "value", "x"): "BR-CL-23", ("currency", "value", "x"): "BR-CL-04", ("currency", "missing", "x"): "BR-05",
    ("lines[0]", "value", "VAT rate must be greater than 0 for category S (BR-S-05)"): "BR-S-05", ("notes", "value", "too long"): "SCHEMA", ("payment", "missing", "x"): "SCHEMA",
}


def error_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda n: _of([e[n] for e in _ERRORS], k)
    return data.load(spark, sf, "part").select(k.alias("issue_id"), invoice_form.rule_of(of(0), of(1), of(2)).alias("rule_id"))


#: header columns and a good and a bad value of each, the path and the rule of the bad one
_BAD = (
    ("type_code", "380", "999", "type_code", "BR-CL-01"), ("currency", "eur", "EURO", "currency", "BR-CL-04"), ("seller_country", "DE", "XX", "seller.address.country", "BR-CL-14"), ("buyer_country", " at", "Austria", "buyer.address.country", "BR-CL-14"),
    ("seller_email", "a@example.com", "a@b", "seller.contact.email", "SCHEMA"), ("buyer_email", "", "a b@example.com", "buyer.contact.email", "SCHEMA"), ("seller_global_id", "4000001543212", "4000001543213", "seller.global_id", "SCHEMA"),
    ("seller_vat_id", "DE 123456789", "DE12345678", "seller.vat_id", "SCHEMA"), ("buyer_vat_id", "EL123456789", "ZZ123456789", "buyer.vat_id", "BR-CO-9"), ("seller_electronic_address", "a@example.com", "0088", "seller", "SCHEMA"),
    ("buyer_electronic_address", "04011000-1234512345-06", "x", "buyer", "SCHEMA"), ("means_code", "58", "98x", "payment.means_code", "BR-CL-16"), ("iban", "DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "payment.iban", "BR-DE-19"),
    ("debtor_iban", "", "DE", "payment.debtor_iban", "BR-DE-19"), ("bic", "COBADEFFXXX", "COBADEFFX", "payment.bic", "SCHEMA"), ("discount_percent", "2", None, "payment", "SCHEMA"),
)


def field_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of orders; the n-th field is bad where the key divides by n + 2."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    values = [F.when(k % n != 0, F.lit(good)).otherwise(F.lit(bad).cast("string")).alias(c) for n, (c, good, bad, _, _) in enumerate(_BAD, 2)]
    rest = [none.alias(c) for c in ("buyer_global_id", "seller_electronic_address_scheme", "buyer_electronic_address_scheme")]
    day = F.lit("2026-01-10").cast("date")
    h = data.load(spark, sf, "orders").select(
        k.alias("inv_id"), *values, *rest, F.lit(14).alias("discount_days"), day.alias("billing_period_start"), F.when(k % 19 != 0, day).otherwise(F.date_sub(day, 1)).alias("billing_period_end"),
        F.lit(True).alias("is_xrechnung"), F.when(k % 23 != 0, "04011000").otherwise(" ").alias("routing_id"),
    )
    return invoice_form.field_issues(h, invoice_form.country_codes(spark)).select("inv_id", "rule_id", "field")


def line_field_issues(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    li = data.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("inv_id"), (n - 1).alias("idx"), F.when((n == 2) & (F.col("l_orderkey") % 3 == 0), "1").alias("position"), F.when(k % 5 != 0, "Stk").otherwise("Furlong").alias("unit"),
        F.when(k % 7 == 0, "4006381333932").otherwise("4006381333931").alias("gtin"), F.when(k % 11 == 0, 0).otherwise(1).cast("decimal(18,4)").alias("quantity"), _of(("S", "AE", "L"), k).alias("vat_category"),
        (k % 2).cast("decimal(5,2)").alias("vat_rate"), F.lit(10).cast("decimal(18,2)").alias("net_price"), F.when(k % 13 == 0, 9).cast("decimal(18,2)").alias("gross_price"),
    )
    return invoice_form.line_field_issues(li)


def adjustment_issues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = data.load(spark, sf, "orders").select(
        k.alias("inv_id"), F.lit("charges[0]").alias("path"), F.when(k % 3 != 0, "freight").otherwise("").alias("reason"), F.when(k % 5 == 0, "FC").alias("reason_code"), (k % 2 == 0).alias("of_line"),
        _of(("S", "K", "M"), k).alias("vat_category"), (F.floor(k / 2) % 2).cast("decimal(5,2)").alias("vat_rate"),
    )
    return invoice_form.adjustment_issues(rows)


def version_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return data.load(spark, sf, "part").select(k.alias("doc_id"), invoice_form.version_text(
        _of(("CII", "UBL", "ZUGFeRD-1.0"), k), _of(("XRECHNUNG", "EXTENDED"), k), F.when(k % 4 == 0, "3.0"), F.when(k % 5 == 0, "factur-x.xml").when(k % 5 == 1, "other.xml"), F.when(k % 3 == 0, "1.0")
    ).alias("version"))


def completed_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices with all amounts calculated, a row for each VAT group."""
    lines, groups = _lines(spark, sf), _breakdown(spark, sf)
    totals = einvoice.document_totals(lines, _adjustments(spark, sf), groups, _declared(spark, sf, groups), _said(spark, sf))
    full = invoice_form.completed(einvoice.calculated_lines(lines), groups, totals)
    lines_sum = F.aggregate("lines", F.lit(0).cast("decimal(29,2)"), lambda s, x: (s + x["line_net_amount"]).cast("decimal(29,2)"))
    return full.select("inv_id", lines_sum.cast("double").alias("line_sum"), F.col("totals.line_total").cast("double").alias("line_total"), F.explode("vat_breakdown").alias("g")).select(
        "inv_id", "line_sum", "line_total", "g.vat_category", F.col("g.basis").cast("double").alias("basis"), F.col("g.tax").cast("double").alias("tax")
    )


QUERIES = (
    upload_checks, document_kinds, statement_loading, column_hints, sheet_currencies, printed_totals, form_addresses, form_invoices, form_issues, form_paths, error_rules, field_issues,
    line_field_issues, adjustment_issues, version_texts, completed_invoices,
)


def _q(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _pick(values, key: str) -> str:
    return f"list_extract({_q(values)}, CAST({key} % {len(values)} AS INT) + 1)"


_FILES = f"""WITH f AS (SELECT p_partkey::VARCHAR AS path, p_partkey % 2 = 0 AS bank, p_partkey % {len(_NAMES)} AS n, p_partkey // {len(_NAMES)} % {len(_CONTENTS)} AS c, {_pick(_NAMES, 'p_partkey')} AS name FROM part),
e AS (SELECT *, CASE n WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.csv' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.doc' WHEN 7 THEN '.tiff' WHEN 8 THEN '.txt' ELSE '' END AS ext,
  CASE c WHEN 0 THEN 'pdf' WHEN 4 THEN 'image' END AS media, CASE WHEN bank THEN 'bank statement' ELSE 'business ledger' END AS label, CASE WHEN bank THEN 'Bank statement: ' ELSE 'Business ledger: ' END AS head FROM f)"""
_MEDIA, _ALL = ", ".join(intake.MEDIA_EXTENSIONS), ", ".join(intake.MEDIA_EXTENSIONS + intake.SHEET_EXTENSIONS)
_FORMS = """WITH n AS (SELECT l_orderkey AS k, count(*) AS n_lines, arg_min('Part ' || l_partkey, (l_linenumber, 'Part ' || l_partkey)) AS first_line, count(*) FILTER (l_linenumber = 2) > 0 AND l_orderkey % 6 = 0 AS free, count(*) FILTER (l_linenumber < 2) AS before FROM lineitem GROUP BY l_orderkey),
o AS (SELECT * FROM orders JOIN n ON k = o_orderkey)"""
_HELP = invoice_form.ADDRESS_HELP.replace("'", "''")

SQL = {
    "upload_checks": f"""{_FILES}, x AS (SELECT *, CASE WHEN name = '' THEN '{intake.NO_NAME}' WHEN ext NOT IN {intake.MEDIA_EXTENSIONS} THEN 'Unsupported file extension ''' || ext || '''. Allowed extensions: {_MEDIA}'
 WHEN c = 2 THEN '{intake.EMPTY}' WHEN media IS NULL THEN '{intake.NOT_AS_DECLARED}' END AS error FROM e) SELECT path, CASE WHEN error IS NULL THEN media END AS kind, error FROM x""",
    "document_kinds": f"""{_FILES}, x AS (SELECT *, CASE WHEN ext NOT IN {intake.MEDIA_EXTENSIONS + intake.SHEET_EXTENSIONS} THEN 'Unsupported ' || label || ' file type ''' || CASE WHEN ext = '' THEN 'none' ELSE ext END || '''. Allowed: {_ALL}'
 WHEN c = 2 THEN head || '{intake.EMPTY}' WHEN ext IN {intake.SHEET_EXTENSIONS} AND c = 3 THEN 'The ' || label || ' is not a valid ' || CASE WHEN ext = '.xlsx' THEN 'Excel' ELSE 'text CSV' END || '{_SHEET_TAIL}'
 WHEN ext IN {intake.MEDIA_EXTENSIONS} AND media IS NULL THEN head || '{intake.NOT_AS_DECLARED}' END AS error FROM e) SELECT path, CASE WHEN error IS NULL THEN coalesce(media, 'spreadsheet') END AS kind, error FROM x""",
    "statement_loading": f"""WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'bank statement' ELSE 'business ledger' END AS label, {_pick(('ledger', 'invoice', 'receipt', 'letter'), 'o_orderkey // 4')} AS t FROM orders),
x AS (SELECT *, k % 4 = 0 AS found, k % 3 = 0 AS got, CASE t WHEN 'invoice' THEN 'an invoice' WHEN 'receipt' THEN 'a receipt' END AS bill FROM d),
y AS (SELECT *, CASE WHEN k % 3 = 1 THEN CASE WHEN NOT found THEN 'the spreadsheet has a header row but no transaction rows.' END
 WHEN k % 5 = 1 THEN CASE WHEN k % 15 = 1 THEN 'the PDF is password-protected.' ELSE 'the document could not be read (OCR processing failed).' END WHEN found THEN NULL
 WHEN k % 7 = 0 THEN 'no readable text was found. If it is a scanned document or photo, upload a sharper, upright scan (at least 200 DPI).' WHEN k % 13 = 0 THEN 'no transaction table was found in the document.'
 WHEN t = 'ledger' THEN CASE WHEN NOT got THEN 'no transaction rows could be read from the document.' END WHEN bill IS NOT NULL AND k % 2 = 0 THEN 'the uploaded file is ' || bill || ', not a bank statement.'
 WHEN bill IS NOT NULL THEN CASE WHEN NOT got THEN 'the uploaded file is ' || bill || ', not a ledger, and its total could not be read reliably.' END
 ELSE 'the uploaded file does not look like a bank statement or ledger' || CASE WHEN k % 5 = 0 THEN ' (a letter)' ELSE '' END || '.' END AS why FROM x)
SELECT k AS doc_id, CASE WHEN why IS NOT NULL THEN 'error' WHEN found THEN 'rows' WHEN bill IS NOT NULL THEN 'invoice' ELSE 'recovered' END AS state, 'Unable to extract transactions from the ' || label || ': ' || why AS error FROM y""",
    "column_hints": "WITH p AS (SELECT c_custkey AS k, c_custkey % 7 - 1 AS a, c_custkey // 7 % 7 - 1 AS b FROM customer) SELECT k AS doc_id, a BETWEEN 0 AND 4 AND b BETWEEN 0 AND 4 AND a <> b AND k % 2 = 0 AS ok FROM p",
    "sheet_currencies": f"""WITH c AS (SELECT o_custkey AS path, o_orderkey % {len(_CELLS)} = 2 AS sign, {_pick(list(_CELLS.values()), 'o_orderkey')} AS code FROM orders),
g AS (SELECT path, list_sort(list_distinct(list(code))) AS codes, bool_or(sign) AS shared FROM c GROUP BY path)
SELECT path, CASE WHEN len(codes) = 1 THEN codes[1] END AS currency, shared, CASE WHEN len(codes) > 1 THEN 'The file mixes several currencies (' || array_to_string(codes, ', ') || '); upload one currency per document.' END AS error FROM g""",
    "printed_totals": "SELECT o_orderkey AS doc_id, o_orderkey % 3 < 2 AS printed FROM orders",
    "form_addresses": f"""WITH a AS (SELECT c_custkey AS k, {_pick(('DE', 'AT', 'FR', None, 'DE'), 'c_custkey')} AS country FROM customer)
SELECT k AS inv_id, CASE WHEN k % 7 <> 0 THEN 'Weg ' || k END AS street, CASE WHEN k % 7 <> 0 AND k % 4 = 0 THEN 'Hof 2' END AS additional_street, CASE WHEN k % 7 <> 0 THEN lpad((k % 100000)::VARCHAR, 5, '0') END AS postcode,
 CASE WHEN k % 7 <> 0 THEN 'Bad Ort' END AS city, CASE WHEN k % 7 <> 0 THEN coalesce(country, 'DE') END AS country FROM a""",
    "form_invoices": f"""{_FORMS} SELECT k AS inv_id, 'R' || k AS invoice_number, 'München' AS seller_city, 'AT' AS buyer_country, CASE WHEN k % 3 = 0 THEN 'Name' END AS contact_name, k % 3 = 0 OR k % 4 = 0 AS has_contact,
 CASE WHEN k % 9 = 0 THEN '58' WHEN k % 8 = 0 THEN '1' END AS means_code, n_lines, first_line, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS gross_total FROM o WHERE NOT free AND k % 5 <> 0 AND k % 7 <> 0""",
    "form_issues": f"""{_FORMS} SELECT k AS inv_id, CASE WHEN free THEN 'VAT-CATEGORY' ELSE 'ADDRESS' END AS rule_id, 'invoice_data.' || CASE WHEN free THEN 'line_items[' || before || '].tax_rate' WHEN k % 5 = 0 THEN 'seller_address' ELSE 'buyer_address' END AS field,
 CASE WHEN free THEN '0 % lines need a VAT category and exemption reason; use /api/einvoice/create-zugferd or /create-xrechnung' ELSE '{_HELP}' END AS message FROM o WHERE free OR k % 5 = 0 OR k % 7 = 0""",
    "form_paths": f"SELECT p_partkey AS issue_id, replace({_pick(list(_PATHS), 'p_partkey')}, '{{k}}', p_partkey::VARCHAR) AS path, 'invoice_data.' || replace({_pick(list(_PATHS.values()), 'p_partkey')}, '{{k}}', p_partkey::VARCHAR) AS field FROM part",
    "error_rules": f"SELECT p_partkey AS issue_id, {_pick(list(_ERRORS.values()), 'p_partkey')} AS rule_id FROM part",
    "field_issues": " UNION ALL ".join(
        f"SELECT o_orderkey AS inv_id, '{rule}' AS rule_id, '{path}' AS field FROM orders WHERE o_orderkey % {n} = 0"
        for n, rule, path in [(n, rule, path) for n, (_, _, _, path, rule) in enumerate(_BAD, 2)] + [(19, "SCHEMA", ""), (23, "BR-DE-15", "routing_id")]
    ),
    "line_field_issues": """WITH l AS (SELECT l_orderkey AS inv_id, l_linenumber - 1 AS idx, l_partkey AS k, list_extract(['S', 'AE', 'L'], CAST(l_partkey % 3 AS INT) + 1) AS cat, CASE WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN '1' ELSE l_linenumber::VARCHAR END AS pos FROM lineitem),
x AS (SELECT inv_id, 'lines[' || idx || ']' AS path, k, CASE WHEN k % 11 = 0 THEN 'quantity must not be 0 (BR-22)' WHEN cat = 'AE' AND k % 2 = 1 THEN 'VAT rate must be 0 for category AE'
 WHEN cat = 'S' AND k % 2 = 0 THEN 'VAT rate must be greater than 0 for category S (BR-S-05)' WHEN k % 13 = 0 THEN 'gross_price must be greater than or equal to net_price (net = gross − price discount)' END AS m FROM l)
SELECT inv_id, 'BR-CL-23' AS rule_id, path || '.unit' AS field, 'Unknown unit ''Furlong''. Use a UN/ECE Rec 20 code (C62, HUR, KGM …) or an alias like ''Stk''' AS message FROM x WHERE k % 5 = 0
UNION ALL SELECT inv_id, 'SCHEMA', path || '.gtin', 'GTIN check digit is invalid' FROM x WHERE k % 7 = 0
UNION ALL SELECT inv_id, CASE WHEN m LIKE '%(BR-22)' THEN 'BR-22' WHEN m LIKE '%(BR-S-05)' THEN 'BR-S-05' ELSE 'SCHEMA' END, path, m FROM x WHERE m IS NOT NULL
UNION ALL SELECT inv_id, 'SCHEMA', '', 'Duplicate line position ''' || pos || '''' FROM l GROUP BY inv_id, pos HAVING count(*) > 1""",
    "adjustment_issues": """WITH a AS (SELECT o_orderkey AS k, list_extract(['S', 'K', 'M'], CAST(o_orderkey % 3 AS INT) + 1) AS cat, o_orderkey // 2 % 2 AS rate FROM orders),
x AS (SELECT k, CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN 'reason or reason_code is required (BR-' || CASE WHEN k % 2 = 0 THEN '42 / BR-44)' ELSE '33 / BR-38)' END WHEN k % 2 = 0 THEN NULL
 WHEN cat = 'K' AND rate <> 0 THEN 'VAT rate must be 0 for category K (BR-IC-06/07)' WHEN cat = 'S' AND rate = 0 THEN 'VAT rate must be greater than 0 for category S (BR-S-06/07)' END AS m FROM a)
SELECT k AS inv_id, 'SCHEMA' AS rule_id, 'charges[0]' AS field, m AS message FROM x WHERE m IS NOT NULL""",
    "version_texts": """WITH p AS (SELECT p_partkey AS k, list_extract(['CII', 'UBL', 'ZUGFeRD-1.0'], CAST(p_partkey % 3 AS INT) + 1) AS syntax, 'XRechnung' || CASE WHEN p_partkey % 4 = 0 THEN ' 3.0' ELSE '' END AS base,
 CASE p_partkey % 5 WHEN 0 THEN 'ZUGFeRD 2.1+ / Factur-X 1.0' WHEN 1 THEN 'ZUGFeRD 2.x' END AS inside FROM part)
SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN base || coalesce(' in ' || inside, ' (' || syntax || ')') WHEN inside IS NOT NULL THEN inside || CASE WHEN k % 3 = 0 THEN ' (XMP version 1.0)' ELSE '' END
 ELSE list_extract(['ZUGFeRD 2.x / Factur-X 1.0 (CII D16B)', 'UBL 2.1', 'ZUGFeRD 1.0'], CAST(k % 3 AS INT) + 1) END AS version FROM p""",
    "completed_invoices": f"{_INVOICES} SELECT g.inv_id, t.line_total::DOUBLE AS line_sum, t.line_total::DOUBLE AS line_total, g.vat_category, g.basis::DOUBLE AS basis, g.tax::DOUBLE AS tax FROM g JOIN t ON t.inv_id = g.inv_id",
}

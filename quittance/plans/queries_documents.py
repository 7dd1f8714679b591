"""Queries of e-invoices, jobs, documents, archives, parsing and exports over derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import checks, dates, money, text
from ..operators import documents, einvoice, jobs
from ..session import cut
from ..sources import sniff
from . import driver_data as data
from .queries_recon import _MERCHANT, _STATEMENTS, _statements

# --- e-invoices from lineitem: a tenth of the lines declare a wrong amount ------------------------


def _lines(spark, sf):
    li = data.load(spark, sf, "lineitem")
    q, price = F.col("l_quantity").cast("decimal(18,4)"), F.expr("cast(cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint) as decimal(18,4)) / 100").cast("decimal(18,4)")
    allowance = F.when(F.col("l_linenumber") % 3 == 0, F.lit(1)).otherwise(0).cast("decimal(19,2)")
    exact = (F.round(q * price, 2) - allowance).cast("decimal(19,2)")
    return li.select(
        F.col("l_orderkey").alias("inv_id"), F.col("l_linenumber").alias("idx"), q.alias("quantity"), price.alias("net_price"), F.lit(None).cast("decimal(18,4)").alias("base_quantity"),
        F.when(F.col("l_returnflag") == "R", "E").when(F.col("l_returnflag") == "A", "Z").otherwise("S").alias("vat_category"), F.round(F.col("l_tax") * 100).cast("decimal(5,2)").alias("vat_rate"),
        allowance.alias("allowance"), F.lit(None).cast("decimal(19,2)").alias("charge"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 == 0, exact + 1).cast("decimal(19,2)").alias("line_net_amount"),
    )


def _adjustments(spark, sf):
    o = data.load(spark, sf, "orders").where("o_orderkey % 4 = 0")
    return o.select(
        F.col("o_orderkey").alias("inv_id"), (F.col("o_orderkey") % 8 == 0).alias("is_charge"), F.lit("2.50").cast("decimal(19,2)").alias("amount"), F.lit("S").alias("vat_category"), F.lit(5).cast("decimal(5,2)").alias("vat_rate")
    )


def _breakdown(spark, sf):
    return einvoice.vat_breakdown(_lines(spark, sf), _adjustments(spark, sf))


def _declared(spark, sf, breakdown):
    """Declared groups: some with a tax off by a cent or by one, some without lines."""
    off = F.when(F.col("inv_id") % 9 == 0, F.lit("0.01")).when(F.col("inv_id") % 7 == 0, F.lit("1.00")).otherwise(F.lit("0.00")).cast("decimal(19,2)")
    b = breakdown.where("inv_id % 3 = 0").select("inv_id", "vat_category", "vat_rate", F.col("basis").alias("basis_amount"), (F.col("tax") + off).cast("decimal(19,2)").alias("tax_amount"), F.lit(None).cast("string").alias("exemption_reason"))
    o = data.load(spark, sf, "orders").where("o_orderkey % 11 = 0")
    extra = o.select(F.col("o_orderkey").alias("inv_id"), F.lit("L").alias("vat_category"), F.lit(7).cast("decimal(5,2)").alias("vat_rate"), F.lit(0).cast("decimal(19,2)").alias("basis_amount"), F.lit(0).cast("decimal(19,2)").alias("tax_amount"), F.lit(None).cast("string").alias("exemption_reason"))
    return b.unionByName(extra)


def _said(spark, sf):
    o = data.load(spark, sf, "orders")
    none = F.lit(None).cast("decimal(19,2)")
    return o.select(
        F.col("o_orderkey").alias("inv_id"), *[none.alias(t) for t in einvoice.TOTALS if t != "allowances"],
        F.when(F.col("o_orderkey") % 6 == 0, F.lit("9.99")).cast("decimal(19,2)").alias("allowances"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("10.00")).cast("decimal(19,2)").alias("prepaid_amount"), none.alias("rounding_amount"),
    )


def _computed(spark, sf):
    """lines, breakdown, declared and totals, each computed once: what several rules read lies behind checkpoints."""
    lines = cut(_lines(spark, sf).repartition("inv_id"))  # invoices stay whole in what follows
    breakdown = cut(einvoice.vat_breakdown(lines, _adjustments(spark, sf)))
    declared = _declared(spark, sf, breakdown)
    totals = cut(einvoice.document_totals(lines, _adjustments(spark, sf), breakdown, declared, _said(spark, sf)))
    return lines, breakdown, declared, totals


def vat_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _breakdown(spark, sf).select("inv_id", "vat_category", *[F.col(c).cast("double").alias(c) for c in ("vat_rate", "basis", "tax")])


def invoice_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = _computed(spark, sf)[3]
    return t.select("inv_id", *[F.col(c).cast("double").alias(c) for c in einvoice.TOTALS])


def line_net_check(spark: SparkSession, sf: str) -> DataFrame:
    return einvoice.line_issues(_lines(spark, sf))


def rule_issues(spark: SparkSession, sf: str) -> DataFrame:
    breakdown = cut(_breakdown(spark, sf))
    return einvoice.vat_issues(breakdown, _declared(spark, sf, breakdown))


def totals_check(spark: SparkSession, sf: str) -> DataFrame:
    return einvoice.total_issues(_computed(spark, sf)[3], _said(spark, sf))


def _headers(breakdown, totals):
    """Headers of the invoices, which break no rule, with the categories and the amount due of each."""
    groups = breakdown.groupBy("inv_id").agg(F.collect_set("vat_category").alias("categories"))
    day, same = F.lit("2026-01-10").cast("date"), {
        "seller_id": "1", "seller_vat_id": "DE123456789", "seller_tax_number": "12/345", "buyer_vat_id": "DE999999999", "buyer_legal_id": "HRB 1", "means_code": "58", "iban": "DE89370400440532013000", "terms": "30 days",
        "type_code": "380", "preceding_invoice": "", "buyer_reference": "04011000-1234512345-06", "seller_contact_name": "Name", "mandate_reference": "M1", "seller_country": "DE", "seller_street": "Street 1",
        "seller_postcode": "10115", "seller_city": "Berlin", "buyer_country": "AT", "buyer_street": "Street 2", "buyer_postcode": "1010", "buyer_city": "Wien",
    }
    fixed = [F.lit(v).alias(c) for c, v in (same | data.HEADER).items()]
    return groups.join(totals.select("inv_id", "payable_amount"), "inv_id").select("*", *[day.alias(c) for c in ("issue_date", "due_date", "delivery_date", "billing_period_start")], F.lit(True).alias("is_xrechnung"), *fixed)


def invoice_report(spark: SparkSession, sf: str) -> DataFrame:
    lines, breakdown, declared, totals = _computed(spark, sf)
    headers = _headers(breakdown, totals)  # not kept: nearly all of its columns are constants, and rules on them are settled in the plan
    none = F.lit(None).cast("decimal(19,2)")
    entries = _adjustments(spark, sf).select("inv_id", F.when(F.col("is_charge"), "charges[0]").otherwise("allowances[0]").alias("path"), "amount", none.alias("base_amount"), none.alias("percent"))
    issues = einvoice.line_issues(lines).unionByName(einvoice.vat_issues(breakdown, declared)).unionByName(einvoice.total_issues(totals, _said(spark, sf)))
    issues = issues.unionByName(einvoice.header_issues(headers)).unionByName(einvoice.percent_issues(entries, headers))
    return einvoice.report(issues, totals)


# --- jobs from events --------------------------------------------------------------------------


def _jobs(spark, sf):
    e = data.load(spark, sf, "events")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv]), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("user"), (F.col("user_id") % 20).cast("string")).alias("owner"), status.alias("status"), (F.col("event_id") % 12 + 1).alias("pages"),
        F.col("value").alias("processing_ms"), (F.col("event_id") % 5).alias("retries"), F.col("ts").alias("updated_at"), F.concat(F.lit("File_"), F.col("event_id").cast("string"), F.lit(".PDF")).alias("filename"),
    )


_STATUS = {"view": "queued", "click": "processing", "purchase": "completed", "error": "failed", "signup": "cancelled"}
_CASE_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"
_JOBS = f"WITH j AS (SELECT event_id AS job_id, 'user' || (user_id % 20) AS owner, {_CASE_STATUS} AS status, event_id % 12 + 1 AS pages, value AS processing_ms, event_id % 5 AS retries, ts AS updated_at, 'File_' || event_id || '.PDF' AS filename FROM events)"


def job_stats(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.stats(_jobs(spark, sf))


def jobs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.by_status(_jobs(spark, sf))


def recent_errors(spark: SparkSession, sf: str) -> DataFrame:
    failed = _jobs(spark, sf).where("status = 'failed'")
    return jobs.latest(failed, "updated_at", "job_id", 10).select("job_id", "owner", "filename")


def list_documents_page(spark: SparkSession, sf: str) -> DataFrame:
    found = jobs.listed(_jobs(spark, sf), status="completed").where(jobs.contains(["filename", "owner"], "file_1"))
    return jobs.page(found, [F.desc("updated_at"), F.desc("job_id")], 2, 10).select("job_id", "filename")


def page_totals(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.page_counts(jobs.listed(_jobs(spark, sf), owner="user3"), 20)


def report_page(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf)
    sections = [(k, j.where(F.col("status") == s).select(F.col("job_id").alias("row_no"), F.col("filename").alias("item"))) for k, s in enumerate(jobs.STATUSES)]
    return jobs.sections_page(sections, 150, 60)


def stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf)
    last = j.agg(F.max("updated_at").alias("now"))
    return jobs.stale(j.crossJoin(F.broadcast(last)), F.col("now"))


def user_quota(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf)
    return jobs.quota(j.select(F.when(F.col("job_id") % 9 == 0, "Guest").otherwise(F.upper("owner")).alias("email"), (F.col("pages") - 3).alias("pages")))


def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import analytics

    rows = _statements(spark, sf)
    docs = data.load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 6 == 5, "failed").otherwise("success").alias("status"), F.lit("12.50").cast("decimal(28,3)").alias("total"))
    out = analytics.batch_summary(docs, rows)
    return out.select("success", "failed", F.col("inflow").cast("double").alias("inflow"), F.col("outflow").cast("double").alias("outflow"))


# --- documents ---------------------------------------------------------------------------------

_LABELS = ("Opening balance and deposit at bank", "Tax invoice with due date, bill to", "Receipt of cashier, subtotal", "Plain words")
_LABELLED = "SELECT doc_id, list_extract([" + ", ".join(f"'{x}'" for x in _LABELS) + "], CAST(doc_id % 4 AS INT) + 1) || ' ' || text AS text FROM documents"


def _documents(spark, sf):
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return data.load(spark, sf, "documents").select("doc_id", F.concat(label, F.lit(" "), "text").alias("text"))


def doc_classify(spark: SparkSession, sf: str) -> DataFrame:
    return documents.classified(_documents(spark, sf))


def _printed(spark, sf):
    """Statement lines printed from bank rows."""
    b = data.bank(spark, sf)
    line = F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "description", F.upper("direction"), F.format_string("%.2f", F.col("amount").cast("double")), F.lit("1.00"))
    return b.select(F.col("row_no").alias("doc_id"), F.concat(F.lit("Statement\n"), line, F.lit("\nno amount here")).alias("text"))


def doc_extract_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents.statement_lines(_printed(spark, sf))


def whitespace_norm(spark: SparkSession, sf: str) -> DataFrame:
    d = data.load(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\t  \n\n\n")).alias("text"))
    return d.select("doc_id", F.md5(text.normal_space(F.col("text"))).alias("clean"))


def llm_context(spark: SparkSession, sf: str) -> DataFrame:
    d = data.load(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.head_and_tail(F.col("text"))).alias("context"), text.snippet(F.col("text")).alias("snippet"))


def part_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = data.load(spark, sf, "conversations")
    parts = c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), F.when(F.col("turn") % 2 == 1, F.substring("text", 1, 12)).alias("title"),
        F.when(F.col("turn") % 3 != 0, F.length("text")).cast("bigint").alias("opening"), F.when(F.col("turn") % 4 != 3, F.length("text")).cast("bigint").alias("closing"), F.substring("text", 1, 20).alias("summary"),
    )
    parts = parts.groupBy("doc_id", "part").agg(*[F.min(x).alias(x) for x in ("title", "opening", "closing", "summary")])
    return documents.merged_parts(parts)


def text_parts(spark: SparkSession, sf: str) -> DataFrame:
    return documents.parts_of(data.load(spark, sf, "documents"), 2000).select("doc_id", "part", F.length("text").alias("n_chars"))


def statement_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _statements(spark, sf)
    sums = rows.groupBy("doc_id").agg((F.sum(F.coalesce("credit", F.lit(0))) - F.sum(F.coalesce("debit", F.lit(0)))).alias("net"))
    closing = (100 + F.col("net") + F.when(F.col("doc_id") % 4 == 0, F.lit("0.05")).when(F.col("doc_id") % 4 == 1, F.lit("0.06")).otherwise(F.lit("0.00")).cast("decimal(10,2)")).cast("decimal(28,3)")
    headers = sums.select("doc_id", F.lit(100).cast("decimal(28,3)").alias("opening"), closing.alias("closing"))
    out = documents.statement_audit(headers, rows)
    return out.select("doc_id", F.col("expected").cast("double").alias("expected"), F.col("closing").cast("double").alias("closing"), "ok")


def archive_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of ten entries, some with a changed payload."""
    o = data.load(spark, sf, "orders")
    k = F.col("o_orderkey")
    own = F.sha2(k.cast("string"), 256)
    before = F.when(k % 10 == 0, F.lit("0" * 64)).otherwise(F.sha2((k - 1).cast("string"), 256))
    entries = o.select(F.floor(k / 10).alias("chain"), (k % 10).alias("line_no"), own.alias("entry_hash"), F.when(k % 23 == 0, own).otherwise(before).alias("prev_hash"), F.lit("x").alias("payload"))
    return documents.chained(entries).select("chain", "line_no", "link_ok", "hash_ok")


# --- parsing and checks ------------------------------------------------------------------------

_SHAPES = ("{w},{d} EUR", "${w}.{d}", "({w}.{d})", "{w}.{d} Dr", "-{w}.{d}", "{w}.{d}-")


def parse_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Prices printed in six ways and read back."""
    p = data.load(spark, sf, "part").select("p_partkey", F.floor("p_retailprice").cast("bigint").cast("string").alias("w"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0").alias("d"))
    pieces = []
    for shape in _SHAPES:
        head, rest = shape.split("{w}")
        mid, tail = rest.split("{d}")
        pieces.append(F.concat(F.lit(head), "w", F.lit(mid), "d", F.lit(tail)))
    printed = F.element_at(F.array(*pieces), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", printed.alias("printed")).select("p_partkey", "printed", money.parse_amount(F.col("printed")).cast("double").alias("amount"), money.amount_marker(F.col("printed")).alias("marker"))


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates printed in five ways and read back."""
    o = data.load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    ways = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "dd MMM yyyy", "MMMM d, yyyy")
    printed = F.element_at(F.array(*[F.date_format("d", w) for w in ways]), (F.col("o_orderkey") % len(ways) + 1).cast("int"))
    return o.select("o_orderkey", dates.parse_date(printed).alias("date"), dates.year_month(printed).alias("month"))


def locale_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Per brand: the decimal mark that its printed prices show."""
    p = data.load(spark, sf, "part")
    comma = F.col("p_brand").endswith("1") | ((F.col("p_size") == 7) & F.col("p_brand").endswith("2"))
    printed = F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", F.when(comma, F.lit(",")).otherwise(F.lit(".")))
    g = p.select("p_brand", printed.alias("t")).groupBy("p_brand").agg(F.bool_or(money.comma_evidence(F.col("t"))).alias("c"), F.bool_or(money.dot_evidence(F.col("t"))).alias("d"))
    return g.select("p_brand", money.one_sided(F.col("c"), F.col("d")).alias("decimal_comma"))


def iban_check(spark: SparkSession, sf: str) -> DataFrame:
    """German-shaped account numbers, of which about one in 97 has the right check digits."""
    c = data.load(spark, sf, "customer")
    iban = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 18, "0"))
    return c.select("c_custkey", checks.iban_ok(iban).alias("ok"))


def gtin_check(spark: SparkSession, sf: str) -> DataFrame:
    p = data.load(spark, sf, "part")
    return p.select("p_partkey", checks.gtin_ok(F.lpad((F.col("p_partkey") * 104729).cast("string"), 13, "0")).alias("ok"))


def unit_normalise(spark: SparkSession, sf: str) -> DataFrame:
    p = data.load(spark, sf, "part")
    return p.groupBy(F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("p_size") % len(_UNITS) + 1)).alias("unit")).agg(F.count(F.lit(1)).alias("n")).select("unit", checks.unit_code(F.col("unit")).alias("code"), "n")


_UNITS = ("Stk", "HUR", "kg", "KG", "pcs", "Std", "lump sum", "zzz")


def content_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of sheet a page's content is by its first bytes."""
    pages = data.load(spark, sf, "pages")
    return pages.groupBy(sniff.kind_of(F.col("html").cast("binary")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def injection_guard(spark: SparkSession, sf: str) -> DataFrame:
    o = data.load(spark, sf, "orders")
    cell = F.element_at(F.array(F.lit("=SUM(A1)"), F.lit("-12.5"), F.lit("plain"), F.lit("+cmd"), F.lit("@x")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", money.guarded(cell).alias("cell"))


QUERIES = (
    vat_breakdown, invoice_totals, line_net_check, rule_issues, totals_check, invoice_report, job_stats, jobs_by_status, recent_errors, list_documents_page, page_totals, report_page,
    stale_jobs, user_quota, batch_summary, doc_classify, doc_extract_lines, whitespace_norm, llm_context, part_merge, text_parts, statement_audit, archive_chain, parse_amounts,
    parse_dates, locale_evidence, iban_check, gtin_check, unit_normalise, content_sniff, injection_guard,
)

_PFX = "CASE vat_category WHEN 'K' THEN 'IC' WHEN 'L' THEN 'AF' WHEN 'M' THEN 'AG' ELSE vat_category END"
_INVOICES = f"""WITH li AS (SELECT l_orderkey AS inv_id, l_linenumber AS idx, CAST(l_quantity AS DECIMAL(18,4)) AS q, CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100 AS DECIMAL(18,4)) AS p,
  CASE l_returnflag WHEN 'R' THEN 'E' WHEN 'A' THEN 'Z' ELSE 'S' END AS vat_category, CAST(round(l_tax * 100) AS DECIMAL(5,2)) AS vat_rate, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS a FROM lineitem),
c AS (SELECT *, CAST(round(q * p, 2) AS DECIMAL(19,2)) - a AS computed, CASE WHEN (inv_id + idx) % 10 = 0 THEN CAST(round(q * p, 2) AS DECIMAL(19,2)) - a + 1 END AS said FROM li),
adj AS (SELECT o_orderkey AS inv_id, o_orderkey % 8 = 0 AS is_charge FROM orders WHERE o_orderkey % 4 = 0),
u AS (SELECT inv_id, vat_category, vat_rate, coalesce(said, computed) AS amount FROM c UNION ALL SELECT inv_id, 'S', 5, CASE WHEN is_charge THEN 2.50 ELSE -2.50 END FROM adj),
g AS (SELECT inv_id, vat_category, vat_rate, sum(amount) AS basis, CAST(round(CAST(sum(amount) * vat_rate / 100 AS DECIMAL(38,6)), 2) AS DECIMAL(19,2)) AS tax FROM u GROUP BY inv_id, vat_category, vat_rate),
d AS (SELECT inv_id, vat_category, vat_rate, basis AS d_basis, tax + CASE WHEN inv_id % 9 = 0 THEN 0.01 WHEN inv_id % 7 = 0 THEN 1.00 ELSE 0 END AS d_tax FROM g WHERE inv_id % 3 = 0 UNION ALL SELECT o_orderkey, 'L', 7, 0, 0 FROM orders WHERE o_orderkey % 11 = 0),
v AS (SELECT g.*, d.d_basis, d.d_tax FROM g LEFT JOIN d ON g.inv_id = d.inv_id AND g.vat_category = d.vat_category AND g.vat_rate = d.vat_rate),
t0 AS (SELECT inv_id, sum(coalesce(said, computed)) AS line_total FROM c GROUP BY inv_id),
t AS (SELECT t0.inv_id, line_total, CASE WHEN a.inv_id IS NOT NULL AND NOT is_charge THEN 2.50 ELSE 0 END AS allowances, CASE WHEN is_charge THEN 2.50 ELSE 0 END AS charges,
  (SELECT sum(coalesce(d_tax, tax)) FROM v WHERE v.inv_id = t0.inv_id) AS vat_total, CASE WHEN t0.inv_id % 5 = 0 THEN 10 ELSE 0 END AS prepaid FROM t0 LEFT JOIN adj a ON a.inv_id = t0.inv_id),
i1 AS (SELECT inv_id, 'CALC-LINE-NET' AS rule_id, 'lines[' || idx || '].line_net_amount' AS field, 'error' AS severity, computed::DECIMAL(19,2)::VARCHAR AS expected, said::DECIMAL(19,2)::VARCHAR AS actual FROM c WHERE said IS NOT NULL AND said <> computed),
i2 AS (SELECT inv_id, 'BR-CO-18' AS rule_id, 'vat_breakdown' AS field, 'error' AS severity, NULL AS expected, NULL AS actual FROM d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.inv_id = d.inv_id AND g.vat_category = d.vat_category AND g.vat_rate = d.vat_rate)
  UNION ALL SELECT inv_id, 'BR-' || {_PFX} || '-09', 'vat_breakdown.tax_amount', CASE WHEN abs(d_tax - tax) <= 0.01 THEN 'warning' ELSE 'error' END, tax::DECIMAL(19,2)::VARCHAR, d_tax::DECIMAL(19,2)::VARCHAR FROM v WHERE d_tax <> tax
  UNION ALL SELECT inv_id, 'BR-' || {_PFX} || '-10', 'vat_breakdown', 'error', NULL, NULL FROM v WHERE vat_category IN ('E', 'AE', 'K', 'G', 'O')),
i3 AS (SELECT inv_id, 'BR-CO-11' AS rule_id, 'totals.allowances' AS field, 'error' AS severity, allowances::DECIMAL(19,2)::VARCHAR AS expected, '9.99' AS actual FROM t WHERE inv_id % 6 = 0 AND allowances <> 9.99)"""
SQL = {
    "vat_breakdown": f"{_INVOICES} SELECT inv_id, vat_category, vat_rate::DOUBLE AS vat_rate, basis::DOUBLE AS basis, tax::DOUBLE AS tax FROM g",
    "invoice_totals": f"{_INVOICES} SELECT inv_id, line_total::DOUBLE AS line_total, allowances::DOUBLE AS allowances, charges::DOUBLE AS charges, (line_total - allowances + charges)::DOUBLE AS net_total, vat_total::DOUBLE AS vat_total, (line_total - allowances + charges + vat_total)::DOUBLE AS gross_total, (line_total - allowances + charges + vat_total - prepaid)::DOUBLE AS payable_amount FROM t",
    "line_net_check": f"{_INVOICES} SELECT * FROM i1",
    "rule_issues": f"{_INVOICES} SELECT * FROM i2",
    "totals_check": f"{_INVOICES} SELECT * FROM i3",
    "invoice_report": f"{_INVOICES}, i AS (SELECT inv_id, severity FROM i1 UNION ALL SELECT inv_id, severity FROM i2 UNION ALL SELECT inv_id, severity FROM i3), n AS (SELECT inv_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY inv_id) SELECT t0.inv_id, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM t0 LEFT JOIN n USING (inv_id)",
    "job_stats": f"{_JOBS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in jobs.STATUSES) + ", sum(CASE WHEN status = 'completed' THEN pages ELSE 0 END)::BIGINT AS pages_done, round(avg(processing_ms) FILTER (status = 'completed'), 2) AS mean_ms, sum(retries)::BIGINT AS retries FROM j",
    "jobs_by_status": f"{_JOBS} SELECT status, count(*) AS n, sum(pages)::BIGINT AS pages, sum(retries)::BIGINT AS retries FROM j GROUP BY status",
    "recent_errors": f"{_JOBS} SELECT job_id, owner, filename FROM j WHERE status = 'failed' ORDER BY updated_at DESC, job_id DESC LIMIT 10",
    "list_documents_page": f"{_JOBS} SELECT job_id, filename FROM j WHERE status = 'completed' AND (contains(lower(filename), 'file_1') OR contains(lower(owner), 'file_1')) ORDER BY updated_at DESC, job_id DESC LIMIT 10 OFFSET 10",
    "page_totals": f"{_JOBS} SELECT count(*) AS total, greatest(1, ceil(count(*) / 20))::BIGINT AS pages FROM j WHERE owner = 'user3'",
    "report_page": f"{_JOBS} SELECT (list_position([" + ", ".join(f"'{s}'" for s in jobs.STATUSES) + "], status) - 1)::INT AS section, job_id AS row_no, filename AS item FROM j ORDER BY section, row_no LIMIT 60 OFFSET 150",
    "stale_jobs": f"{_JOBS} SELECT job_id, retries, CASE WHEN retries < 3 THEN 'requeue' ELSE 'fail' END AS action FROM j WHERE status = 'processing' AND updated_at < (SELECT max(updated_at) FROM j) - INTERVAL 600 SECOND",
    "user_quota": f"{_JOBS} SELECT owner AS email, sum(pages - 3)::BIGINT AS pages FROM j WHERE job_id % 9 <> 0 AND pages > 3 GROUP BY owner",
    "batch_summary": f"{_STATEMENTS}, d AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 6 = 5 THEN 'failed' ELSE 'success' END AS status FROM customer), r AS (SELECT doc_id, sum(coalesce(credit, 0)) AS i, sum(coalesce(debit, 0)) AS o FROM s GROUP BY doc_id) SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status <> 'success') AS failed, sum(coalesce(i, 0))::DOUBLE AS inflow, sum(coalesce(o, 12.5))::DOUBLE AS outflow FROM d LEFT JOIN r USING (doc_id)",
    "doc_classify": "WITH d AS (" + _LABELLED + "), s AS (SELECT doc_id, " + ", ".join(" + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in ps) + f" AS {t}" for t, ps in documents.TYPES.items()) + " FROM d) SELECT *, CASE WHEN greatest(bank_statement, receipt, invoice) < 2 THEN NULL WHEN bank_statement >= greatest(receipt, invoice) THEN 'bank_statement' WHEN receipt >= invoice THEN 'receipt' ELSE 'invoice' END AS document_type FROM s",
    "doc_extract_lines": f"WITH {data.BANK_SQL} SELECT row_no AS doc_id, 1 AS line_no, strftime(date, '%Y-%m-%d') AS date, description || ' ' || upper(direction) AS description, amount::DOUBLE AS debit, CASE WHEN amount = 0 THEN 0.0 END AS credit, 1.0 AS balance FROM bank",
    "llm_context": "SELECT doc_id, md5(CASE WHEN length(text) > 10000 THEN left(text, 7000) || chr(10) || '...' || chr(10) || right(text, 3000) ELSE text END) AS context, left(text, 200) AS snippet FROM documents",
    "part_merge": """WITH p0 AS (SELECT conv_id AS doc_id, turn AS part, CASE WHEN turn % 2 = 1 THEN left(text, 12) END AS title, CASE WHEN turn % 3 <> 0 THEN length(text) END AS opening, CASE WHEN turn % 4 <> 3 THEN length(text) END AS closing, left(text, 20) AS summary FROM conversations),
p AS (SELECT doc_id, part, min(title) AS title, min(opening) AS opening, min(closing) AS closing, min(summary) AS summary FROM p0 GROUP BY ALL)
SELECT doc_id, arg_min(title, part) FILTER (title IS NOT NULL AND title <> '') AS title, arg_min(opening, part) FILTER (opening IS NOT NULL) AS opening, arg_max(closing, part) FILTER (closing IS NOT NULL) AS closing, string_agg(summary, chr(10) || chr(10) ORDER BY part) FILTER (summary <> '') AS summary, count(*) AS parts FROM p GROUP BY doc_id""",
    "statement_audit": f"{_STATEMENTS}, n AS (SELECT doc_id, sum(coalesce(credit, 0)) - sum(coalesce(debit, 0)) AS net FROM s GROUP BY doc_id), e AS (SELECT doc_id, round(100 + net, 2) AS expected, 100 + net + CASE doc_id % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.06 ELSE 0 END AS closing FROM n) SELECT doc_id, expected::DOUBLE AS expected, closing::DOUBLE AS closing, abs(expected - round(closing, 2)) <= 0.05 AS ok FROM e",
    "archive_chain": f"WITH e AS (SELECT o_orderkey AS k, o_orderkey // 10 AS chain, o_orderkey % 10 AS line_no, sha256(o_orderkey::VARCHAR) AS h FROM orders), p AS (SELECT *, CASE WHEN k % 23 = 0 THEN h WHEN k % 10 = 0 THEN repeat('0', 64) ELSE sha256((k - 1)::VARCHAR) END AS prev FROM e) SELECT chain, line_no, prev = coalesce(lag(h) OVER (PARTITION BY chain ORDER BY line_no), repeat('0', 64)) AS link_ok, sha256(prev || '|x') = h AS hash_ok FROM p",
    "parse_amounts": "WITH p AS (SELECT p_partkey, floor(p_retailprice)::BIGINT::VARCHAR AS w, lpad((p_partkey % 100)::VARCHAR, 2, '0') AS d, p_partkey % 6 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN w || ',' || d || ' EUR' WHEN 1 THEN '$' || w || '.' || d WHEN 2 THEN '(' || w || '.' || d || ')' WHEN 3 THEN w || '.' || d || ' Dr' WHEN 4 THEN '-' || w || '.' || d ELSE w || '.' || d || '-' END AS printed, (w || '.' || d)::DOUBLE * CASE WHEN k IN (2, 4, 5) THEN -1 ELSE 1 END AS amount, CASE WHEN k = 3 THEN 'dr' END AS marker FROM p",
    "parse_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 5 = 0 AND month(o_orderdate) >= 10 THEN year(o_orderdate) || '-01' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders",
    "locale_evidence": "WITH p AS (SELECT p_brand, p_brand LIKE '%1' OR (p_size = 7 AND p_brand LIKE '%2') AS c FROM part) SELECT p_brand, CASE WHEN bool_and(c) THEN TRUE WHEN bool_and(NOT c) THEN FALSE END AS decimal_comma FROM p GROUP BY p_brand",
    "iban_check": "SELECT c_custkey, CAST(lpad((c_custkey * 7919)::VARCHAR, 18, '0') || '1314' || lpad((c_custkey % 100)::VARCHAR, 2, '0') AS HUGEINT) % 97 = 1 AS ok FROM customer",
    "gtin_check": "WITH g AS (SELECT p_partkey, lpad((p_partkey * 104729)::VARCHAR, 13, '0') AS g FROM part) SELECT p_partkey, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(g[i] AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(g[13] AS INT) AS ok FROM g",
    "unit_normalise": "WITH u AS (SELECT list_extract(['Stk', 'HUR', 'kg', 'KG', 'pcs', 'Std', 'lump sum', 'zzz'], CAST(p_size % 8 AS INT) + 1) AS unit FROM part) SELECT unit, CASE unit WHEN 'Stk' THEN 'C62' WHEN 'HUR' THEN 'HUR' WHEN 'kg' THEN 'KGM' WHEN 'KG' THEN 'KGM' WHEN 'pcs' THEN 'C62' WHEN 'Std' THEN 'HUR' WHEN 'lump sum' THEN 'LS' END AS code, count(*) AS n FROM u GROUP BY unit",
    "content_sniff": "SELECT CASE WHEN regexp_matches(lower(left(html, 2048)), '<html|<table|<!doctype html') THEN 'html' ELSE NULL END AS kind, count(*) AS n FROM pages GROUP BY 1",
    "injection_guard": "SELECT o_orderkey, list_extract(['''=SUM(A1)', '-12.5', 'plain', '''+cmd', '''@x'], CAST(o_orderkey % 5 AS INT) + 1) AS cell FROM orders",
}

"""Records around the analytics: roles of a reconciliation, progress, expiry, deletes, defaults, summaries, deliveries."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import safe_float
from .jobs import TERMINAL

#: role of an uploaded document and the ending of its id (fixed values)
ROLES = {"bank_statement": "bank", "general_ledger": "ledger"}
#: what a new job holds where nothing is given (fixed values)
JOB_DEFAULTS = {
    "status": "queued", "progress": 0, "total_pages": 0, "processed_pages": 0, "current_stage": "queued", "message": "Job queued for processing",
    "retry_count": 0, "document_type": "auto", "language": "en", "clean_with_ai": True,
}
#: label and field of a document's summary, by type (fixed values); fields with # are amounts
SUMMARY = {
    "bank_statement": (("Bank Name", "bank_name"), ("Account Holder", "account_holder"), ("Account #", "account_number_masked"), ("Currency", "currency"), ("Period", "statement_period"), ("Opening Balance", "#opening_balance"), ("Closing Balance", "#closing_balance")),
    "receipt": (("Merchant", "merchant"), ("Receipt #", "receipt_number"), ("Date", "date"), ("Currency", "currency"), ("Total Amount", "#total"), ("Payment Method", "payment_method")),
    "invoice": (("Invoice #", "invoice_number"), ("Invoice Date", "invoice_date"), ("Supplier", "supplier_name"), ("Customer", "customer_name"), ("Total", "#total")),
}
KOSIT = "array<struct<rule_id string, field string, message string, severity string, line int>>"


def email(value: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit("guest"))


def request_id(value: Column) -> Column:
    """The caller's id without unsafe characters, null if nothing is left."""
    return F.nullif(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^a-zA-Z0-9_\-.:]", ""), F.lit(""))


def file_stem(value: Column, default: str = "document") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(value.cast("string"), r"[^a-zA-Z0-9_\-]", ""), F.lit("")), F.lit(default))


def stored_name(value: Column) -> Column:
    """A file's name for the archive: its last path part, safe characters, no dots or dashes at the ends, 120 at most."""
    last = F.regexp_extract(F.coalesce(value, F.lit("")), r"([^/]*)$", 1)
    safe = F.regexp_replace(F.regexp_replace(F.when(last == "", "file").otherwise(last), r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.coalesce(F.nullif(safe, F.lit("")), F.lit("file")), 1, 120)


def snapped(value: Column, places: int) -> Column:
    """A binary float within 1e-9 of a decimal of so many places as that decimal, else unchanged."""
    near = F.round(value, places)
    return F.when(F.abs(value - near) < 1e-9, near).otherwise(value)


def payment_terms(days: Column, percent: Column, terms: Column) -> Column:
    """The structured cash-discount line, ended by a line break, before free text."""
    line = F.format_string("#SKONTO#TAGE=%d#PROZENT=%s#", days, F.round(percent, 2).cast("decimal(10,2)").cast("string"))
    told = F.concat(F.concat_ws("\n", line, F.nullif(terms, F.lit(""))), F.lit("\n"))
    return F.when(days.isNull() | percent.isNull(), terms).otherwise(told)


def legal_text(director: Column, register: Column, court: Column, more: Column) -> Column:
    """Director, register with its court unless the further text has it, and that text; null if all are empty."""
    full = lambda c: F.nullif(c, F.lit(""))
    known = F.coalesce(more, F.lit("")).contains(full(register))
    listed = F.when(full(register).isNotNull() & ~known, F.concat_ws(", ", F.concat(F.lit("Handelsregister: "), register), full(court)))
    return full(F.concat_ws(", ", F.concat(F.lit("Geschäftsführer: "), full(director)), listed, full(more)))


def document_roles(recs: DataFrame) -> DataFrame:
    """A row for each document of a reconciliation: rec_id, role, kind, document_id. recs: rec_id, a *_kind column per role.

    has_job: PDFs and images are extracted by a job, spreadsheets are read at once.
    """
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_kind").alias("kind"), F.concat_ws("_", F.col("rec_id").cast("string"), F.lit(end)).alias("document_id")) for r, end in ROLES.items()]))
    return recs.select("rec_id", roles.alias("d")).select("rec_id", "d.*", (F.col("d.kind") != "spreadsheet").alias("has_job"))


def progress(recs: DataFrame, roles: DataFrame, jobs: DataFrame) -> DataFrame:
    """rec_id, status, progress of reconciliations. recs: rec_id, status, stage, progress; jobs: document_id, status, progress.

    While extracting: 5 and 0.8 of the documents' mean, spreadsheets and ended jobs counting 100; 0 while all wait.
    """
    ended = ~F.col("has_job") | F.coalesce(F.col("j_status").isin(*TERMINAL), F.lit(False))
    per_role = roles.join(jobs.select("document_id", F.col("status").alias("j_status"), F.col("progress").alias("j_progress")), "document_id", "left")
    sums = per_role.groupBy("rec_id").agg(
        F.sum(F.when(ended, 100).otherwise(F.coalesce("j_progress", F.lit(0)))).alias("total"),
        F.count_if(~ended).alias("pending"), F.count_if(F.col("has_job") & (F.coalesce("j_status", F.lit("queued")) != "queued")).alias("running"),
    )
    extracting = F.col("status").isin("queued", "processing") & (F.coalesce("stage", F.lit("")) != "reconciling")
    state = F.when(extracting & ((F.col("pending") == 0) | (F.col("running") > 0)), "processing").otherwise(F.col("status"))
    done = 5 + F.floor(F.col("total") / len(ROLES) * 0.8)
    told = F.when(extracting, F.when((F.col("pending") > 0) & (state == "queued"), 0).otherwise(done)).otherwise(F.coalesce("progress", F.lit(0)))
    return recs.join(sums, "rec_id", "left").select("rec_id", state.alias("status"), F.when(state == "completed", 100).otherwise(F.least(told, F.lit(100))).cast("bigint").alias("progress"))


def live(rows: DataFrame, now: Column) -> DataFrame:
    """Rows that do not expire or expire later."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def with_retention(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows with the expiry of the guest's record they belong to. owners: key, owner_id, expires_at."""
    guests = owners.where("owner_id is null and expires_at is not null").groupBy(key).agg(F.max("expires_at").alias("guest_expiry"))
    return rows.join(guests, key, "left").withColumn("expires_at", F.coalesce("guest_expiry", "expires_at")).drop("guest_expiry")


def deleted(documents: DataFrame, extractions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without what was asked to go. requests: document_id, owner (null: any). Extractions go by id alone."""
    asked = requests.select("document_id", F.col("owner").alias("by")).distinct()
    gone = (documents["document_id"] == asked["document_id"]) & (asked["by"].isNull() | (documents["owner"] == asked["by"]))
    return documents.join(asked, gone, "left_anti"), extractions.join(asked.select("document_id").distinct(), "document_id", "left_anti")


def new_jobs(rows: DataFrame, now: Column) -> DataFrame:
    """Rows with the fields of a new job; what is missing or null takes its default."""
    given = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    filled = {c: given(c, F.lit(v)) for c, v in JOB_DEFAULTS.items()}
    return rows.withColumns(filled | {"user_email": email(given("user_email", F.lit(None).cast("string"))), "created_at": given("created_at", now), "updated_at": given("updated_at", now)})


def can_cancel(status: Column) -> Column:
    return status.isin("queued", "processing")


def can_retry(status: Column) -> Column:
    return status.isin("failed", "cancelled")


def summary_lines(documents: DataFrame, kind: str) -> DataFrame:
    """doc_id, line_no, label, value of what a document of the type states; empty fields give no line."""
    def value(field):
        if not field.startswith("#"):
            return F.nullif(F.col(field).cast("string"), F.lit(""))
        return F.format_number(F.round(safe_float(F.col(field[1:]).cast("string")).cast("decimal(28,6)"), 2), 2)

    told = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(label).alias("label"), value(field).alias("value")) for i, (label, field) in enumerate(SUMMARY[kind], 1)])
    return documents.select("doc_id", F.explode(F.filter(told, lambda t: t["value"].isNotNull())).alias("t")).select("doc_id", "t.*")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with a position (the place in the invoice where none is given) and whether the invoice has it twice.

    lines: inv_id, idx from 1, position.
    """
    placed = lines.withColumn("position", F.coalesce(F.nullif("position", F.lit("")), F.col("idx").cast("string")))
    return placed.withColumn("is_repeat", F.row_number().over(Window.partitionBy("inv_id", "position").orderBy("idx")) > 1)


def latest_deliveries(log: DataFrame, k: int = 100) -> DataFrame:
    """The last k deliveries of each job (Spark limits groups before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("delivered_at"), F.desc("delivery_id")))
    return log.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def page_lines(lines: DataFrame) -> DataFrame:
    """Lines trimmed, empty ones dropped, confidences of four places within 0 and 1, pages below 1 by their place."""
    clean = lines.withColumn("text", F.trim("text")).where("text != ''")
    return clean.withColumns({"confidence": F.least(F.greatest(F.round("confidence", 4), F.lit(0.0)), F.lit(1.0)), "page": F.when(F.col("page") > 0, F.col("page")).otherwise(F.col("place"))})


def _issues(report: str | None):
    root = ET.fromstring(report)
    found = []
    for m in (e for e in root.iter() if e.tag.rpartition("}")[2] == "message"):
        level, line = (m.get("level") or "error").lower(), m.get("lineNumber") or ""
        if level in ("error", "warning"):
            found.append({"rule_id": m.get("code") or m.get("id") or "KOSIT", "field": m.get("xpathLocation"), "message": " ".join((m.text or "").split()), "severity": level, "line": int(line) if line.isdigit() else None})
    return found


def _reports(reports: pd.Series) -> pd.Series:
    def one(report):
        try:
            return None if report is None or "<!DOCTYPE" in report or "<!ENTITY" in report else _issues(report)
        except ET.ParseError:
            return None

    return reports.map(one)


def validator_results(reports: DataFrame) -> DataFrame:
    """report_id, status, issues of validator reports (XML text); null, unsafe or malformed ones fail without issues.

    skipped where no scenario fits; passed if accepted without errors.
    """
    has = lambda path: F.xpath_boolean("report", F.lit(path))
    issues = F.pandas_udf(_reports, KOSIT)(F.col("report"))
    parsed = reports.withColumn("issues", issues).withColumn("sound", F.when(F.col("issues").isNotNull(), F.col("report")))
    accepted = has("//*[local-name()='assessment']/*[local-name()='accept'] or /*/@valid='true'")
    status = F.when(F.col("issues").isNull(), "failed").when(has("//*[local-name()='noScenarioMatched']"), "skipped").when(accepted & ~F.exists("issues", lambda i: i["severity"] == "error"), "passed").otherwise("failed")
    kept = F.when((status == "skipped") | F.col("issues").isNull(), F.array().cast(KOSIT)).otherwise(F.col("issues"))
    return parsed.select("report_id", status.alias("status"), kept.alias("issues"))


def invoice_entries(documents: DataFrame) -> DataFrame:
    """Invoices and receipts uploaded as a ledger: one entry for the printed total.

    documents: doc_id, kind, number, date (parsed), total (decimal), direction, seller, buyer, is_printed.
    """
    number = F.nullif(F.trim(F.coalesce("number", F.lit(""))), F.lit(""))
    receivable = F.coalesce(F.col("direction") == "receivable", F.lit(False))
    party = F.nullif(F.when(receivable, F.col("buyer")).otherwise(F.col("seller")), F.lit(""))
    name = F.concat_ws(" ", F.initcap("kind"), number)
    return documents.where("total is not null and total != 0 and date is not null and is_printed").select(
        "doc_id", "date", F.concat_ws(" - ", name, party).alias("description"), number.alias("reference"),
        F.abs("total").alias("amount"), F.when(receivable, "credit").otherwise("debit").alias("type"),
        (~F.coalesce(F.col("direction").isin("payable", "receivable"), F.lit(False))).alias("is_direction_unknown"),
    )

"""Files and jobs before they are statements: upload checks, kinds, archives, load errors, currencies of a sheet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import currency, money
from ..sources import sniff

MAX_BYTES = 100 << 20
MAX_BATCH = 50
#: extensions of documents and of spreadsheets (fixed values)
MEDIA_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".webp", ".tiff", ".tif")
SHEET_EXTENSIONS = (".csv", ".tsv", ".txt", ".xlsx", ".xlsm", ".xls")
#: what a role's document is called (fixed values)
LABELS = {"bank_statement": "bank statement", "business_ledger": "business ledger"}
#: error texts (fixed values)
NO_NAME = "Uploaded file must have a valid filename."
EMPTY = "Uploaded file is empty (0 bytes)."
NOT_AS_DECLARED = "File content does not match its declared format (invalid magic signature)."
NO_FILES = "No valid files provided for batch processing."
MEMBERS = "path string, name string, content binary, error string"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, empty for none; dots that begin a name are no extension's."""
    return F.regexp_extract(F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"([^/]*)$", 1), r"^\.*[^.].*(\.[^.]*)$", 1)


def media_kind(content: Column) -> Column:
    """pdf, image or null by the signature."""
    media = sniff.media_of(content)
    return F.when(media == "pdf", "pdf").when(media.isin("jpeg", "png", "webp", "tiff"), "image")


def _size_error(size: Column) -> Column:
    over = _text("File size (", F.format_string("%.2f", size / (1 << 20)), f"MB) exceeds maximum limit of {MAX_BYTES >> 20}MB.")
    return F.when(size > MAX_BYTES, over).when(size == 0, EMPTY)


def uploads(files: DataFrame) -> DataFrame:
    """path, kind, error of single uploads, in the order name, extension, size, signature. files: path, filename, content.

    A null content counts as empty. Images without a signature are errors: nothing decodes them here.
    """
    ext, content = extension(F.col("filename")), F.coalesce("content", F.lit(b""))
    allowed = ", ".join(MEDIA_EXTENSIONS)
    error = F.coalesce(
        F.when(F.coalesce("filename", F.lit("")) == "", NO_NAME),
        F.when(~ext.isin(*MEDIA_EXTENSIONS), _text("Unsupported file extension '", ext, f"'. Allowed extensions: {allowed}")),
        _size_error(F.length(content)),
        F.when(media_kind(content).isNull(), NOT_AS_DECLARED),
    )
    return files.select("path", F.when(error.isNull(), media_kind(content)).alias("kind"), error.alias("error"))


def document_kinds(files: DataFrame) -> DataFrame:
    """path, kind (pdf, image, spreadsheet), error of documents with a role. files: path, role, filename, content.

    A signature of a PDF or an image beats a spreadsheet's extension. Locked PDFs are not told apart.
    """
    ext, content = extension(F.col("filename")), F.coalesce("content", F.lit(b""))
    label = F.coalesce(*[F.when(F.col("role") == r, n) for r, n in LABELS.items()], F.lit("document"))
    head = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 40), F.lit(": "))
    is_sheet, media = ext.isin(*SHEET_EXTENSIONS), media_kind(content)
    allowed = ", ".join(MEDIA_EXTENSIONS + SHEET_EXTENSIONS)
    expected = F.when(ext.isin(".xlsx", ".xlsm", ".xls"), "Excel").otherwise("text CSV")
    error = F.coalesce(
        F.when(~is_sheet & ~ext.isin(*MEDIA_EXTENSIONS), _text("Unsupported ", label, " file type '", F.coalesce(F.nullif(ext, F.lit("")), F.lit("none")), f"'. Allowed: {allowed}")),
        F.concat(head, _size_error(F.length(content))),
        F.when(is_sheet & media.isNull() & sniff.kind_of(content).isNull(), _text("The ", label, " is not a valid ", expected, " file. Upload a CSV, Excel (.xlsx/.xls), PDF or image file.")),
        F.when(~is_sheet & media.isNull(), F.concat(head, F.lit(NOT_AS_DECLARED))),
    )
    return files.select("path", F.when(error.isNull(), F.coalesce(media, F.lit("spreadsheet"))).alias("kind"), error.alias("error"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, name, content in batch.itertuples(index=False):
            if not name.lower().endswith(".zip"):
                yield pd.DataFrame([(path, name, content, None)], columns=["path", "name", "content", "error"])
                continue
            try:
                archive = zipfile.ZipFile(io.BytesIO(content or b""))
            except zipfile.BadZipFile as e:
                yield pd.DataFrame([(path, name, None, f"Failed to unpack zip archive '{name}': {e}")], columns=["path", "name", "content", "error"])
                continue
            with archive:
                for member in archive.namelist():
                    if member.startswith("__MACOSX") or member.endswith("/"):
                        continue
                    try:
                        row = (path, member, archive.read(member), None)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as e:
                        row = (path, name, None, f"Failed to unpack zip archive '{name}': {e}")
                    yield pd.DataFrame([row], columns=["path", "name", "content", "error"])


def unpacked(files: DataFrame) -> DataFrame:
    """path, name, content, error: zip archives by their members, other files as they are. files: path, filename, content.

    Members are read one at a time, with neither folders nor __MACOSX; a broken archive or member is one row with an error.
    """
    named = files.select("path", F.coalesce(F.nullif("filename", F.lit("")), F.lit("upload")).alias("filename"), "content")
    return named.mapInPandas(_members, MEMBERS)


def batch_errors(batches: DataFrame, members: DataFrame) -> DataFrame:
    """batch_id, files, error (or null). batches: batch_id; members: batch_id, error, as of unpacked().

    A batch fails with an archive that cannot be read, without files, and with over 50.
    """
    n = members.groupBy("batch_id").agg(F.count_if(F.col("error").isNull()).alias("files"), F.min("error").alias("broken"))
    many = _text("Batch size (", F.col("files").cast("string"), f" files) exceeds maximum allowed limit of {MAX_BATCH} files.")
    full = batches.join(n, "batch_id", "left").fillna(0, ["files"])
    return full.select("batch_id", "files", F.coalesce("broken", F.when(F.col("files") == 0, NO_FILES), F.when(F.col("files") > MAX_BATCH, many)).alias("error"))


def loaded(documents: DataFrame) -> DataFrame:
    """doc_id, state, error of documents that are to give a statement.

    documents: doc_id, role, kind, status and error of the job, n_rows (rows found), raw_text, triage (the kind a reader gave
    to a text without rows, null for none), recovered (rows it could read), reason. States: rows, recovered, invoice, error.
    """
    label = F.coalesce(*[F.when(F.col("role") == r, n) for r, n in LABELS.items()], F.lit("document"))
    failure = _text("Unable to extract transactions from the ", label, ": ")
    told, sheet = F.lower(F.coalesce("error", F.lit(""))), F.col("kind") == "spreadsheet"
    found, bill = F.coalesce("n_rows", F.lit(0)) > 0, F.col("triage").isin("invoice", "receipt")
    some, blank = F.coalesce("recovered", F.lit(0)) > 0, F.trim(F.coalesce("raw_text", F.lit(""))) == ""
    named = _text("the uploaded file is ", F.when(F.col("triage") == "invoice", "an ").otherwise("a "), F.col("triage"))
    why = F.coalesce(_text(" (", F.substring(F.nullif("reason", F.lit("")), 1, 160), ")"), F.lit(""))
    error = (
        F.when(sheet, F.when(~found, "the spreadsheet has a header row but no transaction rows."))
        .when(~F.col("status").eqNullSafe("completed"), F.when(told.contains("password") | told.contains("encrypt"), "the PDF is password-protected.").otherwise("the document could not be read (OCR processing failed)."))
        .when(found, F.lit(None).cast("string"))
        .when(blank, "no readable text was found. If it is a scanned document or photo, upload a sharper, upright scan (at least 200 DPI).")
        .when(F.col("triage").isNull(), "no transaction table was found in the document.")
        .when(F.col("triage").isin("bank_statement", "ledger"), F.when(~some, "no transaction rows could be read from the document."))
        .when(bill & (F.col("role") == "bank_statement"), _text(named, ", not a bank statement."))
        .when(bill, F.when(~some, _text(named, ", not a ledger, and its total could not be read reliably.")))
        .otherwise(_text("the uploaded file does not look like a bank statement or ledger", why, "."))
    )
    state = F.when(error.isNotNull(), "error").when(found, "rows").when(bill, "invoice").otherwise("recovered")
    return documents.select("doc_id", state.alias("state"), F.concat(failure, error).alias("error"))


def hint_ok(columns: Column, width: Column) -> Column:
    """Whether a map of field to column place is a mapping to trust: within the sheet, no place twice, a date and an amount."""
    known = F.map_filter(columns, lambda f, place: (place >= 0) & (place < width))
    has = lambda f: F.coalesce(F.map_contains_key(known, f), F.lit(False))
    places = F.map_values(known)
    return F.coalesce(F.size(F.array_distinct(places)) == F.size(places), F.lit(False)) & has("date") & (has("debit") | has("credit") | has("amount"))


def sheet_currencies(cells: DataFrame) -> DataFrame:
    """path, currency, shared (a sign of several currencies stands there), error where a file mixes several. cells: path, cell."""
    g = cells.groupBy("path").agg(F.sort_array(F.collect_set(currency.currency_in(F.col("cell")))).alias("codes"), F.coalesce(F.bool_or(currency.shared_in(F.col("cell"))), F.lit(False)).alias("shared"))
    error = F.when(F.size("codes") > 1, _text("The file mixes several currencies (", F.array_join("codes", ", "), "); upload one currency per document."))
    return g.select("path", F.when(F.size("codes") == 1, F.element_at("codes", 1)).alias("currency"), "shared", error.alias("error"))


def is_printed(amount: Column, text: Column) -> Column:
    """Whether an amount stands in a text with either decimal mark."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9][0-9.,'   ]*[0-9]"), F.lit(0))
    value = F.abs(money.quantized(amount))
    same = lambda t, comma: F.coalesce(money.parse_amount(t, F.lit(comma)) == value, F.lit(False))
    return F.coalesce(F.exists(tokens, lambda t: same(t, False) | same(t, True)), F.lit(False))


def expired(files: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Stored files past their retention. files: path, modified_at."""
    return files.where(F.col("modified_at") < now - F.make_dt_interval(days=F.lit(days)))

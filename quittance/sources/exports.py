"""Accounting exports as rows of text: ledger CSV, OFX and QBO, QIF, markdown tables.

Statement rows in: doc_id, row_no, date (text), description, reference, debit, credit. Invoice and receipt items in:
doc_id, row_no, description, quantity, unit_price, amount, total; their documents: doc_id, date, number.
Lines out: doc_id, line_no, line; a file is a document's lines in order (write_lines, file_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.money import guarded
from ..functions.text import category

NO_DATE = "20260101000000"


def amount_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(28,2)").cast("string")


def float_text(c: Column) -> Column:
    """A decimal as the shortest text of the float: one decimal at least, no zeros after that."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(28,6)").cast("string"), "0+$", ""), r"\.$", ".0")


def signed_amount(credit: Column, debit: Column) -> Column:
    """Credits as they are, else debits below zero."""
    zero = F.lit(0)
    return F.when(F.coalesce(credit, zero) > 0, credit).when(F.coalesce(debit, zero) > 0, -debit).otherwise(zero).cast("decimal(28,3)")


def signed_rows(rows: DataFrame) -> DataFrame:
    """Statement rows as entries: doc_id, row_no, date, amount, description, reference, category."""
    text = F.coalesce("description", F.lit(""))
    return rows.select("doc_id", "row_no", "date", signed_amount(F.col("credit"), F.col("debit")).alias("amount"), text.alias("description"), "reference", category(text).alias("category"))


def signed_items(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Items of invoices and receipts as entries, money out: the amount, else the total, else quantity (1) times price."""
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    worth = F.coalesce(some("amount"), some("total"), F.coalesce(some("quantity"), F.lit(1)) * F.coalesce("unit_price", F.lit(0)))
    text = F.coalesce(F.nullif("description", F.lit("")), F.lit("Line Item"))
    joined = items.join(documents.select("doc_id", "date", F.col("number").alias("reference")), "doc_id", "left")
    return joined.select("doc_id", "row_no", "date", (-worth).cast("decimal(28,3)").alias("amount"), text.alias("description"), "reference", category(text).alias("category"))


def ofx_date(text: Column) -> Column:
    """The first eight digits and noon, null where there are fewer."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.concat(F.substring(digits, 1, 8), F.lit("120000")))


def qif_date(text: Column, today: str = "01/01/2026") -> Column:
    """Year, month and day as month/day/year, other texts as they are, none as `today`."""
    iso = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    part = lambda k: F.lpad(F.regexp_extract(F.trim(text), iso, k), 2, "0")
    turned = F.concat_ws("/", part(2), part(3), F.regexp_extract(F.trim(text), iso, 1))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(today)).when(F.trim(text).rlike(iso), turned).otherwise(F.trim(text))


def transaction_id(doc_id: Column, place: Column, date: Column, amount: Column, name: Column) -> Column:
    """The first 16 hexadecimal digits, in capitals, of the md5 of what identifies an entry: its OFX date, amount and name."""
    return F.upper(F.substring(F.md5(F.concat_ws("_", doc_id.cast("string"), place.cast("string"), date, float_text(amount), name)), 1, 16))


def ledger_rows(rows: DataFrame) -> DataFrame:
    """The itemised ledger with a category and guarded text cells."""
    return rows.select("doc_id", "row_no", "date", guarded(F.coalesce("description", F.lit(""))).alias("description"), guarded(F.coalesce("reference", F.lit(""))).alias("reference"), amount_text(F.col("debit")).alias("debit"), amount_text(F.col("credit")).alias("credit"), category(F.coalesce("description", F.lit(""))).alias("category"))


def item_table(items: DataFrame) -> DataFrame:
    """Items of receipts and invoices as a table with a category and guarded text cells; missing texts are a dash."""
    dash = lambda c: guarded(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")))
    return items.select("doc_id", "row_no", dash("description").alias("description"), category(F.coalesce("description", F.lit(""))).alias("category"), "quantity", "unit_price", F.coalesce("amount", "total").alias("amount"))


def with_total(rows: DataFrame) -> DataFrame:
    """Ledger rows followed by each document's TOTAL row."""
    totals = rows.groupBy("doc_id").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), (F.max("row_no") + 1).alias("row_no"))
    none = F.lit(None).cast("string")
    return rows.select("doc_id", "row_no", "date", "description", "debit", "credit").unionByName(totals.select("doc_id", "row_no", none.alias("date"), F.lit("TOTAL").alias("description"), "debit", "credit"))


def _lines(rows: DataFrame, per_row: Column, edges: DataFrame) -> DataFrame:
    """Lines of each row between its document's head and foot (arrays of lines). edges: doc_id, head, foot."""
    body = rows.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), F.posexplode(per_row).alias("k", "line"))
    at = F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("row_no"), F.col("head").alias("lines")), F.struct(F.lit(2**62).alias("row_no"), F.col("foot").alias("lines")))).alias("x")
    ends = edges.select("doc_id", at).select("doc_id", "x.row_no", F.posexplode("x.lines").alias("k", "line"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no", "k"))
    return ends.unionByName(body).select("doc_id", number.alias("line_no"), "line")


def _tag(depth: int, name: str, value: Column | str) -> Column:
    return F.concat(F.lit(" " * depth + f"<{name}>"), F.lit(value) if isinstance(value, str) else value)


#: the first lines of an OFX file (fixed values of the format)
OFX_HEAD = ("OFXHEADER:100", "DATA:OFXSGML", "VERSION:102", "SECURITY:NONE", "ENCODING:USASCII", "CHARSET:1252", "COMPRESSION:NONE", "OLDFILEUID:NONE", "NEWFILEUID:NONE", "", "<OFX>")
_STATUS = ("      <STATUS>", "        <CODE>0", "        <SEVERITY>INFO", "      </STATUS>")


def ofx_lines(entries: DataFrame, documents: DataFrame, now: str, qbo: bool = False) -> DataFrame:
    """An OFX 1.02 statement per document (lines end with CR LF in the file); QBO adds the bank's id.

    entries: signed_rows() or signed_items(); documents: doc_id, currency, bank_name, account, closing (null: 0);
    now: the server's time as yyyymmddhhmmss, which also stands for missing dates.
    """
    order = Window.partitionBy("doc_id").orderBy("row_no")
    escaped = lambda c: F.replace(F.substring(c, 1, 32), F.lit("&"), F.lit("&amp;"))
    filled = lambda c, *rest: F.coalesce(F.nullif(F.col(c), F.lit("")), *rest)
    told = entries.select(
        "doc_id", F.row_number().over(order).alias("row_no"), F.coalesce(ofx_date(F.col("date")), F.lit(now)).alias("day"), ofx_date(F.col("date")).alias("known"), "amount",
        escaped(filled("description", F.lit("Transaction"))).alias("name"), escaped(filled("reference", F.col("category"), F.lit(""))).alias("memo"),
    )
    record = F.array(
        F.lit(" " * 10 + "<STMTTRN>"), _tag(12, "TRNTYPE", F.when(F.col("amount") >= 0, "CREDIT").otherwise("DEBIT")), _tag(12, "DTPOSTED", F.col("day")),
        _tag(12, "TRNAMT", F.col("amount").cast("decimal(28,2)").cast("string")), _tag(12, "FITID", transaction_id(F.col("doc_id"), F.col("row_no"), F.col("day"), F.col("amount"), F.col("name"))),
        _tag(12, "NAME", F.col("name")), _tag(12, "MEMO", F.col("memo")), F.lit(" " * 10 + "</STMTTRN>"),
    )
    span = told.groupBy("doc_id").agg(F.min_by(F.struct("known"), "row_no").alias("first"), F.max_by(F.struct("known"), "row_no").alias("last"), F.count(F.lit(1)).alias("n"))
    d = documents.join(span, "doc_id", "left")
    cleaned = lambda c, default: F.coalesce(F.nullif(F.regexp_replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)), "[^A-Za-z0-9]", ""), F.lit("")), F.lit(""))
    bank = F.coalesce(F.nullif(F.upper(F.substring(cleaned("bank_name", "Bank Institution"), 1, 8)), F.lit("")), F.lit("BANK01"))
    account = F.coalesce(F.nullif(cleaned("account", "XXXX-1234"), F.lit("")), F.lit("12345678"))
    start, end = F.coalesce("first.known", F.lit(NO_DATE)), F.coalesce("last.known", F.lit(now))
    head = (
        *map(F.lit, OFX_HEAD), F.lit("  <SIGNONMSGSRSV1>"), F.lit("    <SONRS>"), *map(F.lit, _STATUS), _tag(6, "DTSERVER", now), F.lit("      <LANGUAGE>ENG"), *([_tag(8, "INTU.BID", "3000")] if qbo else []),
        F.lit("    </SONRS>"), F.lit("  </SIGNONMSGSRSV1>"), F.lit("  <BANKMSGSRSV1>"), F.lit("    <STMTTRNRS>"), _tag(6, "TRNUID", F.col("doc_id").cast("string")), *map(F.lit, _STATUS), F.lit("      <STMTRS>"),
        _tag(8, "CURDEF", F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.lit("INR")))), F.lit("        <BANKACCTFROM>"), _tag(10, "BANKID", bank), _tag(10, "ACCTID", account), F.lit("          <ACCTTYPE>CHECKING"),
        F.lit("        </BANKACCTFROM>"), F.lit("        <BANKTRANLIST>"), _tag(10, "DTSTART", start), _tag(10, "DTEND", end),
    )
    foot = F.array(
        F.lit("        </BANKTRANLIST>"), F.lit("        <LEDGERBAL>"), _tag(10, "BALAMT", amount_text(F.col("closing"))), _tag(10, "DTASOF", end), F.lit("        </LEDGERBAL>"),
        *map(F.lit, ("      </STMTRS>", "    </STMTTRNRS>", "  </BANKMSGSRSV1>", "</OFX>")),
    )
    # records have one length each and are numbered, so a line's number needs no further sort
    before = lambda entries: (entries * 8 + len(head)).cast("bigint")
    body = told.select("doc_id", before(F.col("row_no") - 1).alias("before"), F.posexplode(record).alias("k", "line"))
    ends = d.select("doc_id", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("before"), F.array(*head).alias("lines")), F.struct(before(F.coalesce("n", F.lit(0))).alias("before"), foot.alias("lines")))).alias("x"))
    ends = ends.select("doc_id", "x.before", F.posexplode("x.lines").alias("k", "line"))
    return ends.unionByName(body).select("doc_id", (F.col("before") + F.col("k") + 1).cast("int").alias("line_no"), "line")


def qif_lines(entries: DataFrame, today: str = "01/01/2026") -> DataFrame:
    """A QIF file per document; an entry without reference has no N line. entries: signed_rows() or signed_items()."""
    some = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))
    name = F.coalesce(F.nullif("description", F.lit("")), F.lit("Transaction"))
    record = F.array_compact(F.array(
        F.concat(F.lit("D"), qif_date(F.col("date"), today)), F.concat(F.lit("T"), F.col("amount").cast("decimal(28,2)").cast("string")), F.concat(F.lit("P"), name),
        some("N", F.col("reference")), some("L", F.col("category")), F.lit("^"),
    ))
    none = F.array().cast("array<string>")
    edges = entries.select("doc_id").distinct().select("doc_id", F.array(F.lit("!Type:Bank")).alias("head"), none.alias("foot"))
    return _lines(entries, record, edges)


def csv_lines(rows: DataFrame, title: str = "Ledger") -> DataFrame:
    """A comment block, an empty line, the header and quoted rows; the first line starts with a byte order mark."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    columns = ("date", "description", "reference", "debit", "credit", "category")
    ledger = ledger_rows(rows)
    head = F.array(F.lit(f"﻿# {title}"), F.lit(""), F.lit(",".join(columns)))
    edges = rows.select("doc_id").distinct().select("doc_id", head.alias("head"), F.array().cast("array<string>").alias("foot"))
    return _lines(ledger, F.array(F.concat_ws(",", *[quoted(c) for c in columns])), edges)


def markdown(grid: Column) -> Column:
    """A grid (array of rows) as a markdown table as wide as its first row; repeats of the header go."""
    width = F.size(F.element_at(grid, 1))
    cell = lambda row, k: F.trim(F.replace(F.coalesce(F.try_element_at(row, k), F.lit("")), F.lit("|"), F.lit("\\|")))
    fit = lambda row: F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda k: cell(row, k))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    header = F.element_at(grid, 1)
    rest = F.transform(F.filter(F.slice(grid, F.lit(2), F.size(grid)), lambda r: r != header), lambda r: line(fit(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.array(line(fit(header)), rule), rest), "\n"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Lines of many documents to a file, sorted by document: one document's are found by the files' statistics."""
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "line_no").write.mode("overwrite").parquet(folder)


def file_text(spark: SparkSession, folder: str, doc_id, end: str = "\n") -> DataFrame:
    """One document's file: doc_id, content."""
    found = spark.read.parquet(folder).where(F.col("doc_id") == doc_id)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return found.groupBy("doc_id").agg(F.array_join(ordered, end).alias("content"))

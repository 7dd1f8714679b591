"""Queries of spreadsheet files: files written from all orders, forty customers to a file, and read back; with SQL.

Files are CSV, HTML and SpreadsheetML by turns, the fifth of each five is broken; they wrap narrations, repeat headers and print totals,
and those of over LIMIT rows exceed the limit that the queries set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import spreadsheet
from . import driver_data as data

LIMIT = 460
_HEAD = ("Txn Date", "Narration", "Withdrawal Amt", "Deposit Amt", "Balance")
_UPPER_OF_TWO = ("Txn Date", "Narration", "Amount", "", "Balance")


def _text(c: Column) -> Column:
    return c.cast("decimal(20,2)").cast("string")


def _lines(spark, sf):
    """file, lines (array of cells): an opening row, the orders with what follows them, a total."""
    o, blank = data.load(spark, sf, "orders"), F.lit("")
    paid = F.col("o_orderstatus") == "F"
    entry = F.array(F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" <"), F.col("o_orderpriority"), F.lit(">")), F.when(paid, _text(F.col("o_totalprice"))).otherwise(blank), F.when(paid, blank).otherwise(_text(F.col("o_totalprice"))), blank)
    upper = lambda cells: F.array(*[F.lit(x.upper()) for x in cells])
    again = F.when(F.floor(F.col("o_custkey") / 40) % 5 == 3, upper(_UPPER_OF_TWO)).otherwise(upper(_HEAD))
    more = F.array(blank, F.concat(F.lit("of customer "), F.col("o_custkey").cast("string")), blank, blank, blank)
    k = F.col("o_orderkey")
    lines = F.concat(F.when(k % 50 == 0, F.array(again)).otherwise(F.array().cast("array<array<string>>")), F.array(entry), F.when(k % 7 == 0, F.array(more)).otherwise(F.array().cast("array<array<string>>")))
    grouped = o.groupBy(F.floor(F.col("o_custkey") / 40).alias("file")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", lines.alias("lines")))).alias("held"))
    first = F.array(blank, F.concat(F.lit("Opening balance of "), F.col("file").cast("string")), blank, blank, F.concat(F.col("file").cast("string"), F.lit(".00")))
    last = F.array(blank, F.lit("Total"), blank, blank, F.lit("1.00"))
    return grouped.select("file", F.concat(F.array(first), F.flatten(F.transform("held", lambda h: h["lines"])), F.array(last)).alias("lines"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _joined(lines: Column, cell, before: str, between: str, after: str) -> Column:
    return F.array_join(F.transform(lines, lambda r: F.concat(F.lit(before), F.array_join(F.transform(r, cell), between), F.lit(after))), "")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """path, content."""
    f = _lines(spark, sf)
    head = F.array(F.array(*map(F.lit, _HEAD)))
    two = F.array(F.array(*map(F.lit, _UPPER_OF_TWO)), F.array(*map(F.lit, ("", "", "Debit", "Credit", ""))))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    tags = lambda lines: _joined(lines, _escaped, "<tr><td>", "</td><td>", "</td></tr>")
    cells = lambda lines: _joined(lines, _escaped, "<Row><Cell><Data>", "</Data></Cell><Cell><Data>", "</Data></Cell></Row>")
    xml = lambda lines: F.concat(F.lit('<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet><Table>'), cells(lines), F.lit("</Table></Worksheet></Workbook>"))
    all_lines, kind = F.concat(head, F.col("lines")), F.col("file") % 5
    broken = F.when(F.col("file") % 3 == 0, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.repeat(F.lit("x"), 600).cast("binary"))).when(F.col("file") % 3 == 1, F.substring(xml(all_lines), 1, 400).cast("binary")).otherwise(F.lit("no,header\nat,all\n").cast("binary"))
    content = (
        F.when(kind == 0, _joined(all_lines, quoted, "", ";", "\n").cast("binary"))
        .when(kind == 1, F.concat(F.lit("<html><table><tr><td>Statement</td></tr></table><table>"), tags(all_lines), F.lit("</table></html>")).cast("binary"))
        .when(kind == 2, xml(all_lines).cast("binary"))
        .when(kind == 3, _joined(F.concat(two, F.col("lines")), quoted, "", ",", "\r\n").cast("binary"))
        .otherwise(broken)
    )
    return f.select(F.concat(F.lit("file-"), F.col("file").cast("string")).alias("path"), content.alias("content"))


def _rows(spark, sf):
    return spreadsheet.read_rows(files(spark, sf), max_rows=LIMIT)


def sheet_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return spreadsheet.transactions(_rows(spark, sf)).select("path", "sheet", "date", "description", "debit", "credit")


def sheet_problems(spark: SparkSession, sf: str) -> DataFrame:
    return spreadsheet.problems(_rows(spark, sf))


def sheet_headers(spark: SparkSession, sf: str) -> DataFrame:
    found = spreadsheet.headers(spreadsheet.readable(_rows(spark, sf)))
    columns = F.array_join(F.transform(F.array_sort(F.map_entries("columns")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("path", "sheet_no", "sheet", "header_row", columns.alias("columns"))


def sheet_balances(spark: SparkSession, sf: str) -> DataFrame:
    return spreadsheet.edge_balances(_rows(spark, sf)).select("path", "opening", "closing")


def sheet_previews(spark: SparkSession, sf: str) -> DataFrame:
    shown = spreadsheet.preview(spreadsheet.readable(_rows(spark, sf)))
    return shown.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.aggregate("cells", F.lit(0), lambda s, c: s + F.length(c))).alias("n_chars"))


QUERIES = (sheet_transactions, sheet_problems, sheet_headers, sheet_balances, sheet_previews)

_FILES = f"""WITH o AS (SELECT o_custkey // 40 AS file, 'file-' || (o_custkey // 40) AS path, o_custkey // 40 % 5 AS kind, * FROM orders),
n AS (SELECT file, path, kind, count(*) + count(*) FILTER (o_orderkey % 7 = 0) + count(*) FILTER (o_orderkey % 50 = 0) + CASE WHEN kind = 3 THEN 4 ELSE 3 END AS n FROM o GROUP BY file, path, kind),
g AS (SELECT * FROM n WHERE kind < 4 AND n <= {LIMIT}), h AS (SELECT *, CASE kind WHEN 0 THEN 'csv' WHEN 3 THEN 'csv' WHEN 1 THEN 'table 2' ELSE 'table 1' END AS sheet FROM g)"""
SQL = {
    "sheet_transactions": f"""{_FILES} SELECT path, sheet, strftime(o_orderdate, '%d/%m/%Y') AS date, 'Order ' || o_orderkey || ' <' || o_orderpriority || '>' || CASE WHEN o_orderkey % 7 = 0 THEN ' of customer ' || o_custkey ELSE '' END AS description,
CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(20,2)::VARCHAR END AS debit, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice::DECIMAL(20,2)::VARCHAR END AS credit FROM o JOIN h USING (file, path, kind)""",
    "sheet_problems": f"""{_FILES} SELECT path, CASE WHEN kind = 4 THEN CASE file % 3 WHEN 0 THEN '{spreadsheet.UNREADABLE["xls"]}' WHEN 1 THEN '{spreadsheet.UNREADABLE["xml"]}' ELSE '{spreadsheet.NO_HEADER}' END
WHEN kind IN (0, 3) THEN 'CSV exceeds the maximum of {LIMIT} rows.' ELSE 'Spreadsheet exceeds the maximum of {LIMIT} rows.' END AS error FROM n WHERE kind = 4 OR n > {LIMIT}""",
    "sheet_headers": f"{_FILES} SELECT path, CASE kind WHEN 1 THEN 2 ELSE 1 END AS sheet_no, sheet, CASE kind WHEN 3 THEN 2 ELSE 1 END AS header_row, 'balance=4,credit=3,date=0,debit=2,description=1' AS columns FROM h",
    "sheet_balances": f"{_FILES} SELECT path, file || '.00' AS opening, NULL AS closing FROM h",
    "sheet_previews": f"""{_FILES}, l AS (SELECT path, kind, o_orderkey AS k, 0 AS j, CASE WHEN kind = 3 THEN length('Txn DateNarrationAmountBalance') ELSE length('Txn DateNarrationWithdrawal AmtDeposit AmtBalance') END AS c FROM o WHERE o_orderkey % 50 = 0
  UNION ALL SELECT path, kind, o_orderkey, 1, 10 + least(60, length('Order ' || o_orderkey || ' <' || o_orderpriority || '>')) + length(o_totalprice::DECIMAL(20,2)::VARCHAR) FROM o UNION ALL SELECT path, kind, o_orderkey, 2, length('of customer ' || o_custkey) FROM o WHERE o_orderkey % 7 = 0
  UNION ALL SELECT path, kind, -1, 0, length('Opening balance of ' || file || file || '.00') FROM n UNION ALL SELECT path, kind, 9223372036854775807, 0, length('Total1.00') FROM n
  UNION ALL SELECT path, kind, -3, 0, CASE WHEN kind = 3 THEN length('Txn DateNarrationAmountBalance') ELSE length('Txn DateNarrationWithdrawal AmtDeposit AmtBalance') END FROM n UNION ALL SELECT path, kind, -2, 0, length('DebitCredit') FROM n WHERE kind = 3),
r AS (SELECT path, kind, c, row_number() OVER (PARTITION BY path ORDER BY k, j) AS place FROM l), s AS (SELECT path, count(*) AS n_rows, sum(c)::BIGINT AS n_chars FROM r WHERE place <= 50 GROUP BY path)
SELECT g.path, n_rows + CASE WHEN kind = 1 THEN 1 ELSE 0 END AS n_rows, n_chars + CASE WHEN kind = 1 THEN length('Statement') ELSE 0 END AS n_chars FROM s JOIN g ON g.path = s.path
UNION ALL SELECT path, 2, 13 FROM n WHERE kind = 4 AND file % 3 = 2""",
}

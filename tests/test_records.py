"""Validator reports, requests to delete, texts and defaults of records."""

from pyspark.sql import functions as F

from quittance.operators import matching, records

REPORT = """<r:report xmlns:r="urn:x" valid="{valid}">{scenario}
  <r:message level="error" code="BR-1" xpathLocation="/a" lineNumber="7"> too
   short </r:message><r:message level="warning" id="w">late</r:message><r:message level="information" code="I">x</r:message>
  <r:assessment>{verdict}</r:assessment></r:report>"""


def test_validator_reports(spark):
    ok = '<r xmlns="urn:x" valid="true"><message level="warning" code="W">w</message></r>'
    rows = [
        (1, REPORT.format(valid="true", scenario="", verdict="<r:accept/>")), (2, ok), (3, REPORT.format(valid="false", scenario="<r:noScenarioMatched/>", verdict="")),
        (4, None), (5, "<broken"), (6, '<!DOCTYPE x [<!ENTITY e "1">]><x/>'), (7, '<x valid="false"/>'),
    ]
    found = {r.report_id: r for r in records.validator_results(spark.createDataFrame(rows, "report_id int, report string")).collect()}
    assert {k: r.status for k, r in found.items()} == {1: "failed", 2: "passed", 3: "skipped", 4: "failed", 5: "failed", 6: "failed", 7: "failed"}
    assert [(i.rule_id, i.field, i.message, i.severity, i.line) for i in found[1].issues] == [("BR-1", "/a", "too short", "error", 7), ("w", None, "late", "warning", None)]
    assert [len(found[k].issues) for k in (2, 3, 4, 5, 6, 7)] == [1, 0, 0, 0, 0, 0]


def test_texts(spark):
    row = spark.range(1).select(
        records.request_id(F.lit(" a/b:c ")).alias("a"), records.request_id(F.lit("//")).alias("b"), records.email(F.lit("  ")).alias("c"), records.stored_name(F.lit("x/..Räch nung.pdf_")).alias("d"),
        records.snapped(F.lit(29.700000000000003), 2).alias("e"), records.snapped(F.lit(1.23456), 2).alias("f"), records.legal_text(*[F.lit(None).cast("string")] * 4).alias("g"),
    ).first()
    assert tuple(row) == ("ab:c", None, "guest", "R_ch_nung.pdf", 29.7, 1.23456, None)


def test_undated_rows_match_by_amount_alone(spark):
    schema = "rec_id int, row_no int, id string, date string, amount decimal(28,3), direction string, reference string, tokens array<string>"
    made = lambda rows: spark.createDataFrame([(1, n, f"{n}", d, None, s, None, []) for n, d, s in rows], schema).withColumns({"date": F.to_date("date"), "amount": F.lit(5).cast("decimal(28,3)")})
    bank = made([(1, None, "debit"), (2, "2026-01-01", "debit"), (3, "2026-01-09", "credit")])
    ledger = made([(1, "2026-01-03", "debit"), (2, None, "debit"), (3, "2026-02-01", "debit")])
    pairs = {(r.convention, r.b_row_no, r.l_row_no, r.dd) for r in matching.exact_edges(bank, ledger, 2).collect()}
    assert pairs == {("bank", 1, 1, None), ("bank", 1, 2, None), ("bank", 1, 3, None), ("bank", 2, 1, 2), ("bank", 2, 2, None), ("book", 3, 2, None)}
    chosen = {(r.b_row_no, r.l_row_no) for r in matching.exact_matches(bank, ledger).where("convention = 'bank'").collect()}
    assert chosen == {(2, 1), (1, 2)}


def test_3000_equal_rows_each_way(spark):
    days = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 28).cast("int"))
    rows = spark.range(3000).select(F.lit(1).alias("rec_id"), F.col("id").alias("row_no"), F.col("id").cast("string").alias("id"), days.alias("date"), F.lit(7).cast("decimal(28,3)").alias("amount"), F.lit("debit").alias("direction"), F.lit("").alias("reference"), F.array().cast("array<string>").alias("tokens"))
    assert matching.matched(rows, rows, 2, descriptions=False).count() == 3000

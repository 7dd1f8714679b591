"""What a task holds and what is shuffled do not grow faster than the tables."""

from pyspark.sql import functions as F

from quittance.operators import einvoice, merging, prefix
from quittance.plans import queries_merging, queries_parsing

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_shuffled_once(spark):
    """Without partial rows that name the part for every field, and without a second reading for documents without extraction."""
    parts = queries_merging._statements(spark, SF).localCheckpoint()
    assert _plan(merging.merged(parts, "bank_statement")).count("Exchange hashpartitioning") == 1


def test_documents_without_extraction_stay(spark):
    rows = [(1, 1, None), (1, 2, None), (2, 1, None), (2, 2, ("", None)), (3, 1, ("A", 1.0)), (3, 2, ("B", 2.0))]
    parts = spark.createDataFrame(rows, "doc_id int, part int, extraction struct<merchant: string, total: double>")
    got = {r.doc_id: (r.parts, r.extraction and (r.extraction.merchant, r.extraction.total)) for r in merging.merged(parts, "receipt").collect()}
    assert got == {1: (0, None), 2: (1, ("", None)), 3: (2, ("A", 2.0))}


def test_totals_are_joined_by_invoice(spark):
    """Totals are told apart behind the join, so that an invoice is one row of it and not seven."""
    totals = spark.createDataFrame([(1, *map(float, range(7)))], ["inv_id", *einvoice.TOTALS])
    found = einvoice.total_issues(totals, totals.withColumn("net_total", F.lit(9)).withColumn("charges", F.lit(None).cast("double")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    assert [tuple(r) for r in found.collect()] == [(1, "BR-CO-13", "totals.net_total", "error", "3.00", "9.00")]


def test_printed_texts_are_pages(spark):
    """A page's text does not grow with the table; all numbers are printed."""
    longest = []
    for sf in (SF, LARGER):
        b, texts = queries_parsing._printed_pages(spark, sf)
        numbers = texts.select(F.sum(F.size(F.split("raw_text", " und "))), F.max(F.length("raw_text"))).first()
        assert numbers[0] == b.count()
        longest.append(numbers[1])
    assert longest[1] < 10 * longest[0] / 1.2 and longest[1] < 10_000


def test_numbering_shuffles_rows_once(spark):
    """Numbers of a window over the whole group, without a second shuffle of the rows; null keys are a group."""
    rows = spark.sql("SELECT if(id % 5 = 0, null, if(id < 1500, 1L, id % 3)) AS k, id * 7 % 2003 AS at, array(cast(id AS string)) AS cells FROM range(2000)").repartition(3)
    made = prefix.numbered(rows, ["k"], ["at"], "place", 7)
    want = rows.selectExpr("k", "at", "cells", "row_number() OVER (PARTITION BY k ORDER BY at) AS place")
    assert sorted(map(str, made.select("k", "at", "cells", F.col("place").cast("int")).collect())) == sorted(map(str, want.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("cells" in line for line in _plan(made).splitlines() if "Exchange hashpartitioning" in line) and "row_number" not in plan
    assert "Window" not in _plan(made).split("BroadcastExchange")[0]

"""Merges of parts and sums over ranges, against plain loops."""

import random

from pyspark.sql import Window, functions as F

from quittance.operators import merging, prefix

RANDOM = random.Random(5)
PART = "doc_id int, part int, extraction struct<{}>"


def test_running_sums_over_ranges(spark):
    rows = [(RANDOM.choice([None, "a", "b"]) if i % 3 else "hot", i, RANDOM.choice([None, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, v bigint")
    found = prefix.running(df, ["k"], ["o"], {"n": F.lit(1), "total": F.col("v")}, ranges=7)
    assert found.columns == ["k", "o", "v", "n", "total"]
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.coalesce(F.sum("v").over(w), F.lit(0))})
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    before = prefix.previous(df, ["k"], ["o"], {"was": F.col("v")}, ranges=7)
    wanted = df.withColumn("was", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    assert sorted(map(tuple, before.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    known = prefix.previous(df, ["k"], ["o"], {"was": F.col("v")}, ranges=7, known=True)
    wanted = df.withColumn("was", F.last("v", True).over(Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(map(tuple, known.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    assert prefix.running(df.where("o < 0"), ["k"], ["o"], {"n": F.lit(1)}).collect() == []


def test_no_range_holds_a_hot_group(spark):
    df = spark.range(8000).select(F.lit("hot").alias("k"), "id")
    ranges = prefix.spread(df, ["k"], ["id"], 8).groupBy("__range").count().collect()
    sizes = sorted(r["count"] for r in ranges)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_statement_of_twenty_parts(spark):
    def part(i):
        rows = [("2026-01-15", f"Transaction Part {i} Item {j}", f"REF-{i}-{j}", 50.0 * (j % 2 == 0), 100.0 * (j % 2), 10000.0 + i * 100) for j in range(1, 11)]
        return "Chase Bank", "John Doe", "XXXX-XXXX-1234", "USD", "2026-01-01 to 2026-01-31", 10000.0 if i == 1 else None, 15000.0 if i == 20 else None, rows

    df = spark.createDataFrame([(1, i, part(i)) for i in range(20, 0, -1)], PART.format(merging.SCHEMAS["bank_statement"].type.simpleString()[7:-1]))
    row = merging.audited(merging.merged(df, "bank_statement"), "bank_statement").collect()[0]
    x = row["extraction"]
    assert (x["bank_name"], x["account_holder"], x["account_number_masked"], x["opening_balance"], x["closing_balance"]) == ("Chase Bank", "John Doe", "XXXX-XXXX-1234", 10000.0, 15000.0)
    assert [t["description"] for t in x["transactions"]] == [f"Transaction Part {i} Item {j}" for i in range(1, 21) for j in range(1, 11)]
    assert row["warning"] is None  # 10000 - 5000 + 10000 = 15000
    rows = merging.merged_rows(df, "bank_statement").orderBy("row_no").collect()
    assert [(r["row_no"], r["description"]) for r in rows] == list(enumerate(t["description"] for t in x["transactions"]))


def test_invoice_and_receipt(spark):
    fields = "invoice_number string, supplier struct<name: string, tax_id: string, email: string>, customer struct<name: string, address: string>, subtotal double, tax double, total double, line_items array<struct<description: string, amount: double>>, colour string"
    parts = [(1, 0, ("INV-2026-999", ("Acme Corp", None, "billing@acme.com"), ("Client Inc", "123 Main St"), None, None, None, [("Server hosting", 500.0)], "red")), (1, 1, (None, ("", "TAX-123456", None), None, 1500.0, 150.0, 1650.0, [("Consulting services", 1000.0)], "x")), (1, 2, None), (2, 7, ("", None, None, 10.0, None, 12.5, None, ""))]
    rows = {r["doc_id"]: r for r in merging.audited(merging.merged(spark.createDataFrame(parts, PART.format(fields)), "invoice"), "invoice").collect()}
    x = rows[1]["extraction"]
    assert (x["invoice_number"], x["supplier"]["name"], x["supplier"]["tax_id"], x["customer"]["address"], x["total"], rows[1]["parts"]) == ("INV-2026-999", "Acme Corp", "TAX-123456", "123 Main St", 1650.0, 2)
    assert [i["description"] for i in x["line_items"]] == ["Server hosting", "Consulting services"] and rows[1]["warning"] is None
    alone = rows[2]["extraction"]  # one part passes as it is
    assert alone["invoice_number"] == "" and alone["supplier"] is None and alone["line_items"] == []
    assert rows[2]["warning"]["message"] == "Invoice total mismatch: Subtotal (10.0) + Tax (0.0) = 10.00, but extracted total is 12.5."
    receipts = spark.createDataFrame([(1, 0, ("", 5.0, 1.0)), (1, 1, ("Shop", None, 3.0)), (1, 2, ("Other", 7.25, None)), (3, 0, None)], PART.format("merchant string, total double, discount double"))
    rows = {r["doc_id"]: r["extraction"] for r in merging.merged(receipts, "receipt").collect()}
    assert rows[3] is None and (rows[1]["merchant"], rows[1]["total"], rows[1]["discount"], rows[1]["line_items"]) == ("Shop", 7.25, 3.0, [])


def test_general(spark):
    fields = "title string, summary string, key_value_pairs map<string, string>, tables array<array<array<string>>>"
    parts = [(1, 2, (None, "", {"x": "9"}, None)), (1, 0, ("", "a", {"x": "1", "y": "2"}, [[["q"]]])), (1, 1, ("U", "b", {"y": None, "z": "4"}, [[["r"], ["s", None]]]))]
    x = merging.merged(spark.createDataFrame(parts, PART.format(fields)), "general").collect()[0]["extraction"]
    assert (x["title"], x["summary"], x["key_value_pairs"], x["tables"]) == ("U", "a\n\nb", {"x": "9", "y": None, "z": "4"}, [[["q"]], [["r"], ["s", None]]])
    assert merging.merged(spark.createDataFrame([], PART.format(fields)), "general").collect() == []

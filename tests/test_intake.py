"""Uploads, archives, batches and the flat form, by cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quittance.operators import intake, invoice_form


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return bytearray(out.getvalue())


def test_archives_by_their_members(spark):
    good = _zip([("a/", b""), ("a/x.pdf", b"%PDF-"), ("__MACOSX/x", b"."), ("y.csv", b"")])
    files = spark.createDataFrame([("1", "B.ZIP", good), ("2", "bad.zip", bytearray(b"PK")), ("3", None, bytearray(b"x")), ("4", "n.zip", None)], "path string, filename string, content binary")
    got = {(r["path"], r["name"], None if r["content"] is None else bytes(r["content"])): r["error"] for r in intake.unpacked(files).collect()}
    assert {k: v for k, v in got.items() if v is None} == {("1", "a/x.pdf", b"%PDF-"): None, ("1", "y.csv", b""): None, ("3", "upload", b"x"): None}
    assert got[("2", "bad.zip", None)].startswith("Failed to unpack zip archive 'bad.zip': ") and ("4", "n.zip", None) in got and len(got) == 5


def test_batches(spark):
    batches = spark.createDataFrame([(1,), (2,), (3,), (4,)], "batch_id int")
    members = spark.createDataFrame([(1, None)] * 50 + [(2, None)] * 51 + [(4, "broken"), (4, None)], "batch_id int, error string")
    got = {r["batch_id"]: (r["files"], r["error"]) for r in intake.batch_errors(batches, members).collect()}
    assert got == {1: (50, None), 2: (51, "Batch size (51 files) exceeds maximum allowed limit of 50 files."), 3: (0, intake.NO_FILES), 4: (1, "broken")}


def test_size_limit_and_nulls(spark):
    files = spark.createDataFrame([("1", "a.pdf", bytearray(b"%PDF-1")), ("2", "a.pdf", None), ("3", None, bytearray(b"x"))], "path string, filename string, content binary")
    assert {r["path"]: (r["kind"], r["error"]) for r in intake.uploads(files).collect()} == {"1": ("pdf", None), "2": (None, intake.EMPTY), "3": (None, intake.NO_NAME)}
    said = spark.range(1).select(intake._size_error(F.lit((100 << 20) + 1)).alias("e")).first()["e"]
    assert said == "File size (100.00MB) exceeds maximum limit of 100MB."
    assert intake.uploads(files.where("false")).count() == 0 and intake.document_kinds(files.withColumn("role", F.lit(None).cast("string"))).count() == 3


def test_retention(spark):
    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-02 00:00:01"), ("c", None)], "path string, t string").select("path", F.col("t").cast("timestamp").alias("modified_at"))
    assert [r["path"] for r in intake.expired(rows, F.lit("2026-01-09 00:00:00").cast("timestamp")).collect()] == ["a"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Lieferantenstraße 20, 80333 München, DE", ("Lieferantenstraße 20", None, "80333", "München", "DE")),
        ("Weg 1\nHof 2, Haus 3, A-1010 Wien, austria", ("Weg 1", "Hof 2, Haus 3", "1010", "Wien", "AT")),
        ("Weg 1, 80333 München", ("Weg 1", None, "80333", "München", "DE")),
        ("80333 München, DE", None),
        ("Weg 1, München", None),
        ("DE", None),
        ("", None),
        (None, None),
    ],
)
def test_addresses(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(invoice_form.parsed_address(F.col("t"), ["DE", "AT"]).alias("a"))
    got = df.first()["a"]
    assert (None if got is None else tuple(got)) == want


def test_country_codes(spark):
    codes = invoice_form.country_codes(spark)
    assert {"DE", "AT", "US", "AX", "SS", "TL"} <= set(codes) and "XX" not in codes and 245 <= len(codes) <= 252


def test_printed_amounts(spark):
    cases = [("1234.5", "total 1.234,50 EUR", True), ("1234.50", "total 1,234.50", True), ("-7", "x 7.00", True), ("7", "no digits", False), ("1234.50", "1234", False), (None, "12.00", False), ("12", None, False)]
    df = spark.createDataFrame([(a, t, i) for i, (a, t, _) in enumerate(cases)], "a string, t string, i int")
    got = {r["i"]: r["p"] for r in df.select("i", intake.is_printed(F.col("a").cast("decimal(28,3)"), F.col("t")).alias("p")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_hints(spark):
    df = spark.createDataFrame([({"date": 0, "amount": 1},), ({"date": 0, "amount": 0},), ({"date": 0, "amount": 9},), ({"amount": 1},), (None,)], "m map<string,int>")
    assert [r[0] for r in df.select(intake.hint_ok(F.col("m"), F.lit(3))).collect()] == [True, False, False, False, False]

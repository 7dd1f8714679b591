"""Parsers and checks against known values."""

import pytest
from pyspark.sql import functions as F

from quittance.functions import checks, dates, money, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_amounts(spark):
    cases = {
        "1,234.56": 1234.56, "1.234,56": 1234.56, "₹1,23,456.78": 123456.78, "€ 1 234,50": 1234.5, "(500.00)": -500, "-42": -42, "500.00-": -500, "Rs. 1,000": 1000, "12,5": 12.5,
        "1'234.50": 1234.5, "1.234.567": 1234567, "−7.25": -7.25, "75.00 Dr": 75, "abc": None, "": None, "1-2": None, "--5": None, "9" * 40: None, "2.345": 2.35, ".5": 0.5,
    }
    got = column(spark, list(cases), money.parse_amount)
    assert [None if g is None else float(g) for g in got] == list(cases.values())
    assert column(spark, ["75.00 Dr", "60 CR.", "fedr", "12"], money.amount_marker) == ["dr", "cr", None, None]


def test_amounts_by_convention(spark):
    comma = lambda v: money.parse_amount(v, F.lit(True))
    point = lambda v: money.parse_amount(v, F.lit(False))
    assert [None if x is None else float(x) for x in column(spark, ["1.234", "1,234", "1,234,56", "12.50"], comma)] == [1234, 1.23, None, 12.5]
    assert [float(x) for x in column(spark, ["1.234", "1,23", "1,234,567"], point)] == [1.23, 123, 1234567]
    yen = lambda v: money.money_text(money.parse_amount(v, None, F.lit("JPY")), F.lit("JPY"))
    dinar = lambda v: money.money_text(money.parse_amount(v, F.lit(False), F.lit("KWD")), F.lit("KWD"))
    assert column(spark, ["1234.5"], yen) == ["1235"] and column(spark, ["1234.5678"], dinar) == ["1234.568"]


def test_dates(spark):
    cases = {
        "2026-10-01": "2026-10-01", "01/02/2026": "2026-02-01", "1-2-26": "2026-02-01", "31.12.99": "1999-12-31", "5 Jan 2026": "2026-01-05", "05-Jan-26": "2026-01-05", "January 5, 2026": "2026-01-05",
        "12/31/2026": "2026-12-31", "2026-10-01T10:20:30Z": "2026-10-01", "01/02/2026 10:30 PM": "2026-02-01", "2026/3/4": "2026-03-04", "31/02/2026": None, "hello": None, "": None, "5 September 2026": "2026-09-05",
    }
    got = column(spark, list(cases), dates.parse_date)
    assert [None if g is None else str(g) for g in got] == list(cases.values())
    first = lambda v: dates.parse_date(v, F.lit(True))
    assert [str(x) for x in column(spark, ["01/02/2026", "10/13/26", "13/10/2026"], first)] == ["2026-01-02", "2026-10-13", "None"]
    assert [str(x) for x in column(spark, [46296.0, 12.5, 80001.0], dates.serial_date, "double")] == ["2026-10-01", "None", "None"]
    assert column(spark, ["2026-10-15", "15/04/2026", "15-Jan-2026", "none", "2026-4-1"], dates.year_month) == ["2026-01", "2026-04", "2026-01", "2026-01", "2026-04"]


def test_text(spark):
    assert column(spark, ["NETFLIX.COM", "uber trip", "Smart shop", "unknown"], text.category) == ["Entertainment & Subscriptions", "Travel & Commute", "Groceries", "Miscellaneous"]
    assert column(spark, ["Apple iCloud", "cult.fit", "x"], text.subscription) == ["Apple", "Cult.Fit", None]
    assert column(spark, ["inv-12/a", None], text.normal_reference) == ["INV12A", ""]
    assert column(spark, ["Payment to the ACME Ltd 2026 acme a"], text.tokens) == [["acme", "payment"]]
    assert column(spark, ["a  b\t c \n\n\n\n d\n"], text.normal_space) == ["a b c\n\nd"]
    pairs = spark.createDataFrame([("1", "1"), ("A1", "A1"), ("123", "123"), ("INV123", "XINV1234"), ("AB", "ABC"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(text.references_match(F.col("a"), F.col("b"))).collect()] == [False, True, True, True, False, False]


def test_checks(spark):
    assert column(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "GB82WEST12345698765432", "x", None], checks.iban_ok) == [True, False, True, False, False]
    assert column(spark, ["4006381333931", "4006381333932", "96385074", "12", None], checks.gtin_ok) == [True, False, True, False, False]
    assert column(spark, ["DEUTDEFF", "DEUTDEFF500", "DEUT"], checks.bic_ok) == [True, True, False]
    assert column(spark, ["DE123456789", "DE12345678", "FR12345678901"], checks.vat_id_ok) == [True, False, True]
    assert column(spark, ["04011000-1234512345-06", "04011000-1234512345-07", "zzz"], checks.leitweg_ok) == [True, False, None]


@pytest.mark.parametrize("value,want", [("=1+1", "'=1+1"), ("-5", "-5"), ("+x", "'+x"), ("ok", "ok"), (" @a", "' @a")])
def test_guard(spark, value, want):
    assert column(spark, [value], money.guarded) == [want]

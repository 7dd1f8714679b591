"""Statement dates in many formats, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scope import let

NUMERIC = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2}|\d{4})$"
TRAILING_TIME = r"[ T]\d{1,2}:\d{2}(:\d{2})?(\.\d+)?\s*([AaPp][Mm])?$"
SHORT = r"^(\d{1,2}[ -][A-Za-z]{3,})[ -](\d{2})$"
#: tried in order after numeric day-first dates (fixed values): pattern of the text, format
FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}/[A-Za-z]{3}/\d{4}$", "d/MMM/yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3,}-\d{4}$", "d-MMMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{3,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2} [A-Za-z]{3}, \d{4}$", "d MMM, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,}, \d{4}$", "d MMMM, yyyy"),
)


def _made(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def without_time(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), TRAILING_TIME, ""))


def parse_date(text: Column, month_first: Column | None = None) -> Column:
    """The date of a text, day-first where ambiguous unless month_first; null for none.

    Two-digit years up to 68 are 20xx, later ones 19xx (month-first: all 20xx). Whole numbers
    from 20000 to 80000 are spreadsheet serials counted from 1899-12-30.
    """
    month_first = F.coalesce(month_first, F.lit(False)) if month_first is not None else F.lit(False)

    def numeric(x):
        part = [F.regexp_extract(x["s"], NUMERIC, k).try_cast("int") for k in (1, 2, 3)]
        return let(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(part)], x["s"].alias("s"), x["mf"].alias("mf")), dated)

    def dated(x):
        century = F.when(x["p2"] >= 100, 0).otherwise(F.when(x["mf"] | (x["p2"] <= 68), 2000).otherwise(1900))
        swapped = _made(x["p2"] + century, x["p0"], x["p1"])
        # a four-digit month-first date is the last resort of day-first reading, with slashes only
        resort = F.when(x["s"].contains("/") & (x["p2"] >= 100), swapped)
        return F.when(x["mf"], swapped).otherwise(F.coalesce(_made(x["p2"] + century, x["p1"], x["p0"]), resort))

    def named(s):
        # 09 Jun 26 and 09-Jun-26
        day, year = F.regexp_extract(s, SHORT, 1), F.regexp_extract(s, SHORT, 2).try_cast("int")
        full = F.when(s.rlike(SHORT), F.concat(F.regexp_replace(day, "-", " "), F.lit(" "), (year + F.when(year <= 68, 2000).otherwise(1900)).cast("string")))
        return F.coalesce(*[F.when(s.rlike(p), F.try_to_date(s, f)) for p, f in FORMATS], let(full, lambda t: F.coalesce(F.try_to_date(t, "d MMM yyyy"), F.try_to_date(t, "d MMMM yyyy"))))

    iso = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd"))
    other = let(F.struct(without_time(text).alias("s"), month_first.alias("mf")), lambda x: F.when(x["s"].rlike(NUMERIC), numeric(x)).otherwise(named(x["s"])))
    return F.coalesce(iso, other)


def serial_date(value: Column) -> Column:
    """The date of a spreadsheet's day number, null outside 20000 to 80000."""
    return F.when(value.between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value).cast("int")))


def day_first_evidence(text: Column) -> Column:
    return F.regexp_extract(without_time(text), NUMERIC, 1).try_cast("int") > 12


def month_first_evidence(text: Column) -> Column:
    return F.regexp_extract(without_time(text), NUMERIC, 2).try_cast("int") > 12


def day_difference(a: Column, b: Column) -> Column:
    """Days between two dates, null where either is missing."""
    return F.abs(F.datediff(a, b))


def year_month(text: Column) -> Column:
    """yyyy-MM of a statement date: year first, else day and month first, else a month's name; 2026-01 by default.

    As published: one-digit months are tried before two-digit ones, so that ISO months
    10 to 12 read as 01, and a slashed date's second part is the month.
    """
    s = F.trim(text)
    first = r"(\d{4})[-/.](0?[1-9]|1[0-2])"
    slashed = r"(?:0?[1-9]|[12]\d|3[01])[-/.](0?[1-9]|1[0-2])[-/.](\d{4})"

    def month(pattern, year_at, month_at):
        found = F.concat(F.regexp_extract(s, pattern, year_at), F.lit("-"), F.lpad(F.regexp_extract(s, pattern, month_at), 2, "0"))
        return F.when(s.rlike(pattern), found)

    named = [F.when(s.rlike(p), F.try_to_date(s, f)) for p, f in FORMATS if "MMM" in f]
    return F.coalesce(month(first, 1, 2), month(slashed, 2, 1), F.date_format(F.coalesce(*named), "yyyy-MM"), F.lit("2026-01"))

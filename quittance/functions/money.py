"""Locale-dependent amounts as exact decimals, in column expressions.

Amounts are decimal(28,3); what does not fit or is no amount is null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scope import let

MONEY = "decimal(28,3)"
#: currencies whose minor units differ from 2 (fixed values, ISO 4217)
NO_DECIMALS = "BIF CLP DJF GNF ISK JPY KMF KRW PYG RWF UGX VND VUV XAF XOF XPF".split()
THREE_DECIMALS = "BHD IQD JOD KWD LYD OMR TND".split()

_MARKER = r"(?i)(?<![a-z])(dr|cr)\.?\s*$"


def minor_units(currency: Column) -> Column:
    """Decimal places of a currency, 2 by default."""
    return F.when(currency.isin(NO_DECIMALS), 0).when(currency.isin(THREE_DECIMALS), 3).otherwise(2)


def quantized(value: Column, currency: Column | None = None) -> Column:
    """Half-up to the currency's minor units (2 where no currency is given)."""
    if currency is None:
        return F.round(value, 2).cast(MONEY)
    units = minor_units(currency)
    return F.when(units == 0, F.round(value, 0).cast(MONEY)).when(units == 3, F.round(value, 3).cast(MONEY)).otherwise(F.round(value, 2).cast(MONEY))


def money_text(value: Column, currency: Column | None = None) -> Column:
    """An amount with as many decimals as its currency has."""
    two = F.round(value, 2).cast("decimal(28,2)").cast("string")
    if currency is None:
        return two
    units = minor_units(currency)
    return F.when(units == 0, F.round(value, 0).cast("decimal(28,0)").cast("string")).when(units == 3, F.round(value, 3).cast("decimal(28,3)").cast("string")).otherwise(two)


def _last(text: Column, char: str) -> Column:
    """Place of a character's last occurrence, 0 for none."""
    return let(F.instr(F.reverse(text), char), lambda back: F.when(back > 0, F.length(text) - back + 1).otherwise(0))


def plain_number(number: Column, decimal_comma: Column) -> Column:
    """1.234,56 or 1,234.56 or 1,23,456.78 as a plain number with a point; null if it is none.

    decimal_comma: true, false, or null for no evidence in the document.
    """

    def read(x):
        n, comma, dot, forced = x["n"], x["comma"], x["dot"], F.coalesce(x["forced"], F.lit(False))
        no_commas, no_dots = F.replace(n, F.lit(",")), F.replace(n, F.lit("."))
        commas, dots = F.length(n) - F.length(no_commas), F.length(n) - F.length(no_dots)
        as_decimal = F.coalesce(x["forced"], (commas == 1) & (F.length(n) - comma).isin(1, 2))
        pointed = F.concat(F.replace(F.substring(n, F.lit(1), comma - 1), F.lit(",")), F.lit("."), F.substring(n, comma + 1, F.length(n)))
        both = F.when(comma > dot, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas)
        only_commas = F.when(forced & (commas > 1), F.lit(None).cast("string")).when(as_decimal, pointed).otherwise(no_commas)
        only_dots = F.when((dots > 1) | (forced & (F.length(n) - dot == 3)), no_dots).otherwise(n)
        return F.when((dot > 0) & (comma > 0), both).when(comma > 0, only_commas).when(dot > 0, only_dots).otherwise(n)

    parts = F.struct(number.alias("n"), _last(number, ".").alias("dot"), _last(number, ",").alias("comma"), decimal_comma.alias("forced"))
    return let(parts, read)


def amount_marker(text: Column) -> Column:
    """dr, cr or null: the side printed behind an amount."""
    found = F.lower(F.regexp_extract(F.trim(text), _MARKER, 1))
    return F.when(found != "", found)


def parse_amount(text: Column, decimal_comma: Column | None = None, currency: Column | None = None) -> Column:
    """The amount of a printed number, with currency words, signs, brackets and group marks; else null."""
    decimal_comma = F.lit(None).cast("boolean") if decimal_comma is None else decimal_comma
    core = F.trim(F.regexp_replace(F.trim(text), _MARKER, ""))
    core = F.regexp_replace(F.replace(core, F.lit("−"), F.lit("-")), r"(?U)[^\W\d_]+\.?", "")
    core = F.regexp_replace(core, r"[^0-9.,\-()]", "")

    def unsigned(s):
        return F.struct((s.contains("(") & s.endswith(")")).alias("negative"), F.regexp_replace(s, r"[()]", "").alias("s"))

    def led(x):
        trailing = x["s"].endswith("-") & ~x["s"].startswith("-")
        moved = F.concat(F.lit("-"), F.substring(x["s"], F.lit(1), F.length(x["s"]) - 1))
        return F.struct(x["negative"].alias("negative"), F.when(trailing, moved).otherwise(x["s"]).alias("s"))

    def valued(x):
        number = F.when(F.regexp_replace(x["s"], "^-", "").contains("-"), F.lit(None).cast("string")).otherwise(plain_number(x["s"], decimal_comma))
        value = let(number, lambda n: F.when(n.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), n).try_cast("decimal(38,9)"))
        return let(value, lambda v: F.when(x["negative"], -F.abs(v)).otherwise(v))

    limit = F.lit("1" + "0" * 25).cast("decimal(38,9)")
    value = let(let(let(core, unsigned), led), valued)
    return let(value, lambda v: F.when(F.abs(v) < limit, quantized(v, currency)))


def comma_evidence(text: Column) -> Column:
    """Whether an amount string shows a decimal comma."""
    core = F.regexp_replace(text, r"[^0-9.,]", "")
    return core.rlike(r"\d,\d{1,2}$|\.\d{3},\d+$")


def dot_evidence(text: Column) -> Column:
    core = F.regexp_replace(text, r"[^0-9.,]", "")
    return core.rlike(r"\d\.\d{1,2}$|,\d{3}\.\d+$")


def one_sided(some: Column, other: Column) -> Column:
    """True or false where only one side has evidence, null where both or neither have (aggregates of booleans)."""
    some, other = F.coalesce(some, F.lit(False)), F.coalesce(other, F.lit(False))
    return F.when(some & ~other, True).when(other & ~some, False)


def safe_float(text: Column) -> Column:
    """A number of which all but digits, points and signs is dropped; null for none (a comma is no decimal mark)."""
    s = F.trim(text)
    empty = F.lower(s).isin("", "none", "null", "n/a", "-")
    return F.when(~empty, F.regexp_replace(s, r"[^0-9.\-+]", "").try_cast("double"))


def guarded(text: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a leading apostrophe; numbers stay."""
    risky = F.trim(text).rlike(r"^[=+\-@\t\r]")
    return F.when(risky & text.try_cast("double").isNull(), F.concat(F.lit("'"), text)).otherwise(text)

"""Currencies by code and symbol, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: active ISO 4217 codes (fixed values)
CODES = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP
GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR
MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP
TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XCG XOF XPF YER ZAR ZMW ZWG ZWL
""".split()
#: symbols of one currency (fixed values)
SYMBOLS = {
    "CA$": "CAD", "C$": "CAD", "CAN$": "CAD", "AU$": "AUD", "A$": "AUD", "AUS$": "AUD", "NZ$": "NZD", "US$": "USD", "U$S": "USD", "HK$": "HKD", "S$": "SGD", "SG$": "SGD", "R$": "BRL", "MX$": "MXN", "NT$": "TWD",
    "£": "GBP", "€": "EUR", "₹": "INR", "RS": "INR", "RS.": "INR", "₨": "INR", "₩": "KRW", "₺": "TRY", "₽": "RUB", "₱": "PHP", "₦": "NGN", "฿": "THB", "₫": "VND", "₪": "ILS", "₴": "UAH", "₸": "KZT",
    "ZŁ": "PLN", "KČ": "CZK", "FT": "HUF", "RM": "MYR", "CN¥": "CNY", "JP¥": "JPY", "RMB": "CNY",
}
#: symbols that several currencies share (fixed values)
SHARED = ("$", "¥", "KR", "KR.", "R", "FR", "LEI")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normal_currency(value: Column) -> Column:
    """The ISO code of a code or an unshared symbol, else null."""
    code = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""))
    return F.when(code.isin(CODES), code).otherwise(F.try_element_at(_map(SYMBOLS), code))


def is_shared(value: Column) -> Column:
    return F.upper(F.trim(value)).isin(*SHARED)


def currency_in(text: Column) -> Column:
    """A currency printed in an amount or header: a code of three capitals, else the longest symbol that stands alone."""
    codes = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([A-Z]{3})(?![A-Za-z])"), F.lit(1)), lambda c: c.isin(CODES))
    upper, found = F.upper(text), F.lit(None).cast("string")
    for symbol in sorted(SYMBOLS, key=lambda s: (len(s), s)):
        quoted = "".join("\\" + c if c in "$." else c for c in symbol)
        found = F.when(upper.rlike(f"(?<![A-Z]){quoted}(?![A-Z])"), F.lit(SYMBOLS[symbol])).otherwise(found)
    return F.coalesce(F.try_element_at(codes, F.lit(1)), found)


#: signs of currencies, those of several among them (fixed values)
SIGNS = "$£€₹₨₩₺₽₱₦฿₫₪₴₸¥"


def shared_in(text: Column) -> Column:
    """Whether a text names no one currency but has a symbol that several share, or another sign."""
    left = F.upper(F.regexp_replace(text, "[0-9\\s.,'()+\u2212-]", ""))
    return F.coalesce(currency_in(text).isNull() & (left.isin(*SHARED) | left.rlike(f"[{SIGNS}]")), F.lit(False))

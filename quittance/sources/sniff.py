"""What a file's bytes are, whatever its name, in column expressions over its content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: leading bytes in hexadecimal (fixed values)
SIGNATURES = {"xlsx": "504B0304", "xls": "D0CF11E0A1B11AE1"}
MEDIA = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "tiff": "49492A00", "tiff_big_endian": "4D4D002A", "bmp": "424D"}


def _head(content: Column, n: int) -> Column:
    return F.hex(F.substring(content, 1, n))


def text_of(content: Column, n: int = 8192) -> Column:
    """The first bytes as text: UTF-8 where valid, else Latin-1; UTF-16 by its byte order mark."""
    head = F.substring(content, 1, n)
    wide = _head(content, 2).isin("FFFE", "FEFF")
    return F.when(wide, F.decode(head, "UTF-16")).otherwise(F.coalesce(F.try_validate_utf8(head.cast("string")), F.decode(head, "ISO-8859-1")))


def media_of(content: Column) -> Column:
    """pdf, png, jpeg, tiff, bmp, webp or null."""
    found = F.when(_head(content, 4).eqNullSafe("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
    for kind, signature in MEDIA.items():
        found = found.when(_head(content, len(signature) // 2) == signature, kind.split("_")[0])
    return found


def delimiter_of(text: Column) -> Column:
    """The mark of , ; tab | that splits the most early lines in two or more filled cells, null for none."""
    lines = F.slice(F.split(text, r"\r?\n"), 1, 50)
    best = None
    for mark, pattern in ((",", ","), (";", ";"), ("\t", "\t"), ("|", r"\|")):
        hits = F.size(F.filter(lines, _filled(pattern)))
        x = F.struct(hits.alias("hits"), F.lit(mark).alias("mark"))
        best = x if best is None else F.when(x["hits"] > best["hits"], x).otherwise(best)
    return F.when(best["hits"] > 0, best["mark"])


def _filled(pattern: str):
    return lambda line: F.size(F.filter(F.split(line, pattern), lambda c: F.trim(c) != "")) >= 2


def kind_of(content: Column) -> Column:
    """xlsx, xls, xml, html, csv or null."""
    text = text_of(content)
    head = F.lower(F.ltrim(F.regexp_replace(F.substring(text, 1, 2048), "^﻿", "")))
    markup = head.rlike(r"^<(html|!doctype html|table|meta|head|body)") | (head.startswith("<") & F.lower(text).contains("<table"))
    binary = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0E-\x1F]")) > F.length(text) / 100 + 2
    return (
        F.when(_head(content, 4) == SIGNATURES["xlsx"], "xlsx")
        .when(_head(content, 8) == SIGNATURES["xls"], "xls")
        .when(text.contains("\x00") | binary, F.lit(None).cast("string"))
        .when(head.startswith("<?xml") & F.lower(text).contains("urn:schemas-microsoft-com:office:spreadsheet"), "xml")
        .when(markup, "html")
        .when(delimiter_of(text).isNotNull(), "csv")
    )

"""JSON out of noisy text: reasoning tags, code fences, comments, trailing commas, cut-off ends."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def stripped(text: Column) -> Column:
    """The text without tags, fences, comments and trailing commas, from its first brace or bracket."""
    t = F.regexp_replace(F.trim(text), r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(F.trim(t), r"(?i)^```(?:json)?\s*|\s*```$", "")
    t = F.regexp_replace(t, r"^[^{\[]*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)(^|[\s,{\[])//.*$", "$1"), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(t, r",\s*([\]}])", "$1")


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def closed(text: str) -> str | None:
    """A cut-off document with its open string and brackets closed, cut back to the last point where that parses."""
    for cut in (len(text), text.rfind("}") + 1, text.rfind(",")):
        if cut <= 0:
            continue
        part, quoted, skip, opened = text[:cut], False, False, []
        for c in part:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{[":
                opened.append("}" if c == "{" else "]")
            elif not quoted and opened and c == opened[-1]:
                opened.pop()
        made = (part + '"' * quoted).rstrip().rstrip(",") + "".join(reversed(opened))
        try:
            json.loads(made, strict=False)
            return made
        except ValueError:
            pass
    return None


@F.pandas_udf(StringType())
def _closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else closed(t))


def repaired(text: Column) -> Column:
    """Parseable JSON text, or null; only what does not parse as it stands goes through Python."""
    s = stripped(text)
    return F.when(is_json(s), s).otherwise(_closed(s))


def as_object(text: Column) -> Column:
    """Lists are wrapped as {"items": [...]}."""
    return F.when(text.startswith("["), F.concat(F.lit('{"items": '), text, F.lit("}"))).otherwise(text)

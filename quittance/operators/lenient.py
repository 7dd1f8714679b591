"""Typing of JSON that may deviate: fields are cast where they can be, the text passes through, and a warning says what is wrong.

Everything is done by expressions; only texts that are no JSON at all go to a Python worker, which finds the line and column.

Cases: null texts have no value, no warning and no place; JSON that is no object deviates as a whole; fields that are missing or null are
null and do not deviate; unknown fields are left in the text; repeated rows are typed row by row; an empty table gives no rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, _parse_datatype_string

#: codes of the warnings (fixed values)
DEVIATES, BROKEN = "SCHEMA_VALIDATION_WARNING", "INVALID_JSON"
PLACE = "struct<line: int, column: int, message: string>"


def _place(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        try:
            json.loads(text)
            out.append((None, None, "not readable"))  # stricter than Python: repeated keys, or numbers that are none
        except json.JSONDecodeError as e:
            out.append((e.lineno, e.colno, e.msg))
        except (TypeError, RecursionError):
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["line", "column", "message"])


def _fits(kind: DataType, found: Column) -> Column:
    """Whether a value of the found type may stand for the wanted one: texts must be texts, lists lists, objects objects."""
    if isinstance(kind, StringType):
        return found == "STRING"
    if isinstance(kind, ArrayType):
        return found.startswith("ARRAY")
    if isinstance(kind, StructType):
        return found.startswith("OBJECT")
    return ~(found.startswith("ARRAY") | found.startswith("OBJECT"))


def typed(rows: DataFrame, schema: str, text: str = "json") -> DataFrame:
    """rows with value (struct of the schema; null for no object), deviating (names of fields whose values do not fit; these are null) and
    warning (struct of code, message, line, column; null where all fits). The text itself stays as it is."""
    wanted = _parse_datatype_string(f"struct<{schema}>")
    parsed = rows.withColumns({"__v": F.try_parse_json(text)})
    parsed = parsed.withColumns({"__kind": F.schema_of_variant("__v")})
    whole = F.col("__kind").startswith("OBJECT")
    fields, off = [], []
    for f in wanted.fields:
        raw = F.try_variant_get("__v", f"$['{f.name}']", "variant")
        kind = F.schema_of_variant(raw)
        cast = F.when(whole & _fits(f.dataType, kind), F.try_variant_get("__v", f"$['{f.name}']", f.dataType.simpleString()))
        fields.append(cast.alias(f.name))
        there = whole & raw.isNotNull() & (kind != "VOID")
        off.append(F.when(there & cast.isNull(), F.lit(f.name)))
    made = parsed.withColumns({"value": F.when(whole, F.struct(*fields)), "deviating": F.filter(F.array(*off), lambda n: n.isNotNull())})
    broken = F.col(text).isNotNull() & F.col("__v").isNull()
    made = made.withColumn("__at", F.when(broken, F.pandas_udf(_place, PLACE)(F.when(broken, F.col(text)))))
    warn = lambda code, message, line, column: F.struct(F.lit(code).alias("code"), message.alias("message"), line.alias("line"), column.alias("column"))
    none = F.lit(None).cast("int")
    said = F.concat(F.lit("Model output partially deviated from schema: "), F.when(whole, F.array_join("deviating", ", ")).otherwise(F.lit("not an object")))
    warning = F.when(broken, warn(BROKEN, F.col("__at.message"), F.col("__at.line"), F.col("__at.column"))).when(~whole | (F.size("deviating") > 0), warn(DEVIATES, said, none, none))
    return made.withColumn("warning", warning).drop("__v", "__kind", "__at")

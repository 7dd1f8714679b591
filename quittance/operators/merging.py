"""Merging the structured extractions of a document's parts into one, field by field.

A schema says what each field takes: the first part that has anything, the first or last that is not null, all rows in
order, all texts, or of each key the last value. Each rule is an associative aggregate over (part, value). Parts cross the
shuffle once and as they are: a document's rows come together anyway, and partial rows would name the part for every field.

`merged` keeps a document's rows nested in its one row, as a caller of the reference gets them; `merged_rows` numbers rows
across parts without bringing a document's rows together, for documents of any size.

Cases: parts go by `part`; a part whose extraction is null does not count; a document with one part is passed on as it
is; fields that the extraction lacks are null; null lists are empty; of rows with equal part numbers the order is the
lists' own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, _parse_datatype_string

from . import prefix

PARTY = "struct<name: string, address: string, tax_id: string, email: string, phone: string>"
_ITEM = "struct<description: string, quantity: double, unit_price: double, {}>"


@dataclass(frozen=True)
class Schema:
    """Fields of a kind of document in order, and what each takes from the parts."""

    ddl: str
    first: tuple[str, ...] = ()  # the first that is not empty
    first_known: tuple[str, ...] = ()  # the first that is not null
    last_known: tuple[str, ...] = ()
    rows: str | None = None  # lists end to end
    parties: tuple[str, ...] = ()  # structs, each field the first that is not empty
    joined: tuple[str, ...] = ()  # texts with an empty line between
    maps: tuple[str, ...] = field(default=())  # of each key the last value

    @property
    def type(self) -> StructType:
        return _parse_datatype_string(self.ddl)


SCHEMAS = {
    "bank_statement": Schema(
        "bank_name string, account_holder string, account_number_masked string, currency string, statement_period string, opening_balance double, closing_balance double, "
        "transactions array<struct<date: string, description: string, reference: string, debit: double, credit: double, balance: double>>",
        first=("bank_name", "account_holder", "account_number_masked", "currency", "statement_period"),
        first_known=("opening_balance",),
        last_known=("closing_balance",),
        rows="transactions",
    ),
    "invoice": Schema(
        f"invoice_number string, invoice_date string, due_date string, supplier {PARTY}, customer {PARTY}, currency string, line_items array<{_ITEM.format('tax_rate: double, amount: double')}>, "
        "subtotal double, tax double, total double",
        first=("invoice_number", "invoice_date", "due_date", "currency"),
        last_known=("subtotal", "tax", "total"),
        rows="line_items",
        parties=("supplier", "customer"),
    ),
    "receipt": Schema(
        f"merchant string, receipt_number string, date string, currency string, subtotal double, tax double, discount double, total double, payment_method string, line_items array<{_ITEM.format('total: double')}>",
        first=("merchant", "receipt_number", "date", "currency", "payment_method"),
        last_known=("subtotal", "tax", "discount", "total"),
        rows="line_items",
    ),
    "general": Schema(
        "title string, summary string, key_value_pairs map<string, string>, tables array<array<array<string>>>",
        first=("title",),
        joined=("summary",),
        maps=("key_value_pairs",),
        rows="tables",
    ),
}


def _first_by(value: Column, order: Column, told: Column) -> Column:
    return F.min_by(value, F.when(told, order))


def _in_order(value: Column, told: Column) -> Column:
    """The values where `told` holds, by part."""
    held = F.sort_array(F.collect_list(F.when(told, F.struct(F.col("part").alias("part"), F.col("place").alias("place"), value.alias("value")))))
    return F.transform(held, lambda x: x["value"])


def _last_keys(maps: Column, kind: str) -> Column:
    """One map of many, later keys before earlier."""
    none = F.from_json(F.lit("{}"), kind)
    return F.aggregate(maps, none, lambda held, new: F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(new, k)), new))


def merged(parts: DataFrame, kind: str) -> DataFrame:
    """doc_id, parts (how many have an extraction), extraction (the schema's struct; null without any).

    parts: doc_id, part, extraction (a struct; of the schema's fields those that it lacks are null).
    """
    schema = SCHEMAS[kind]
    # fields and places are made behind the shuffle; parts without extraction have null fields
    source = parts.select("doc_id", "part", "extraction").repartition("doc_id").select("doc_id", "part", F.col("extraction").isNotNull().alias("known"), *_fields(parts, schema))
    source = source.withColumn("place", _place(schema))
    order = F.struct("part", "place")
    some = lambda c: F.coalesce(c != "", F.lit(False))
    made: dict[str, Column] = {}
    for f in schema.first:
        made[f] = _first_by(F.col(f), order, some(F.col(f)))
    for f in schema.first_known:
        made[f] = _first_by(F.col(f), order, F.col(f).isNotNull())
    for f in schema.last_known:
        made[f] = F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order))
    for f in schema.parties:
        names = schema.type[f].dataType.names
        made[f] = F.struct(*[_first_by(F.col(f)[n], order, some(F.col(f)[n])).alias(n) for n in names])
    for f in schema.joined:
        texts = _in_order(F.col(f), some(F.col(f)))
        made[f] = F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))
    for f in schema.maps:
        entries = _in_order(F.map_entries(f), F.col(f).isNotNull())
        made[f] = _last_keys(F.transform(entries, F.map_from_entries), schema.type[f].dataType.simpleString())
    made[schema.rows] = F.flatten(_in_order(F.col(schema.rows), F.col(schema.rows).isNotNull()))
    # a single part keeps empty texts and missing parties as they are
    raw = [*schema.first, *schema.parties, *schema.joined]
    known = F.count_if("known")
    grouped = source.groupBy("doc_id").agg(
        known.alias("parts"), (known == 1).alias("one"), F.first(F.when(F.col("known"), F.struct(*raw)), True).alias("raw"), F.struct(*[made[f].alias(f) for f in schema.type.names]).alias("made")
    )
    fields = [(F.when(F.col("one"), F.col("raw")[f]).otherwise(F.col("made")[f]) if f in raw else F.col("made")[f]).alias(f) for f in schema.type.names]
    return grouped.select("doc_id", "parts", F.when(F.col("parts") > 0, F.struct(*fields)).alias("extraction"))


def conformed(value: Column, had: DataType, wanted: DataType) -> Column:
    """The value with the wanted type; fields are taken by name, those it lacks are null."""
    if isinstance(wanted, StructType) and isinstance(had, StructType):
        names = set(had.names)
        fields = [(conformed(value[f.name], had[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(wanted, ArrayType) and isinstance(had, ArrayType):
        return F.transform(value, lambda x: conformed(x, had.elementType, wanted.elementType))
    return value.cast(wanted)


def _fields(parts: DataFrame, schema: Schema) -> list[Column]:
    whole = conformed(F.col("extraction"), parts.schema["extraction"].dataType, schema.type)
    return [whole[n].alias(n) for n in schema.type.names]


def _place(schema: Schema) -> Column:
    """Tells parts of one number apart; maps have no order or hash, their entries have."""
    values = [F.map_entries(f) if f in schema.maps else F.col(f) for f in schema.type.names]
    return F.xxhash64(*values)


def merged_rows(parts: DataFrame, kind: str) -> DataFrame:
    """doc_id, row_no (from 0 over all parts), part, and the fields of each row (`row` where it is no struct).

    Rows never come together by document: parts are counted, their counts added up in front of each part, and rows
    numbered within their part from there.
    """
    schema = SCHEMAS[kind]
    source = parts.where("extraction is not null").select("doc_id", "part", *_fields(parts, schema))
    source = source.select("doc_id", "part", _place(schema).alias("place"), F.col(schema.rows).alias("held")).where("size(held) > 0")
    placed = prefix.running(source, ["doc_id"], ["part", "place"], {"until": F.size("held").cast("bigint")})
    rows = placed.select("doc_id", "part", (F.col("until") - F.size("held")).alias("from"), F.posexplode("held").alias("k", "row"))
    whole = isinstance(schema.type[schema.rows].dataType.elementType, StructType)
    return rows.select("doc_id", (F.col("from") + F.col("k")).alias("row_no"), "part", "row.*" if whole else "row")


#: code and text of what audits report (fixed values; {} are amounts)
WARNINGS = {
    "bank_statement": ("FINANCIAL_ARITHMETIC_MISMATCH", "Bank statement balance check mismatch: Opening ({}) - Debits ({}) + Credits ({}) = {}, but extracted closing balance is {}."),
    "invoice": ("INVOICE_TOTAL_MISMATCH", "Invoice total mismatch: Subtotal ({}) + Tax ({}) = {}, but extracted total is {}."),
    "receipt": ("RECEIPT_TOTAL_MISMATCH", "Receipt total mismatch: Subtotal ({}) + Tax ({}) - Discount ({}) = {}, but extracted total is {}."),
}


def audited(documents: DataFrame, kind: str) -> DataFrame:
    """documents (of `merged`) with `warning`, a struct of code and message where the amounts miss each other by over 0.05, else null.

    Amounts are added as exact decimals; statements without rows and documents without the amounts are not audited.
    """
    if kind not in WARNINGS:
        return documents.withColumn("warning", F.lit(None).cast("struct<code: string, message: string>"))
    x = F.col("extraction")
    exact = lambda c: F.coalesce(c, F.lit(0.0)).cast("decimal(28,6)")
    if kind == "bank_statement":
        total = lambda f: F.aggregate(x["transactions"], F.lit(0).cast("decimal(38,6)"), lambda s, t: (s + exact(t[f])).cast("decimal(38,6)"))
        debits, credits = total("debit"), total("credit")
        start, end, asked = x["opening_balance"], x["closing_balance"], F.size(x["transactions"]) > 0
        expected = exact(start) - debits + credits
        shown = [_number(start), _cents(debits), _cents(credits)]
    else:
        start, end, asked = x["subtotal"], x["total"], F.lit(True)
        expected, shown = exact(start) + exact(x["tax"]), [_number(start), _number(F.coalesce(x["tax"], F.lit(0.0)))]
        if kind == "receipt":
            expected, shown = expected - exact(x["discount"]), [*shown, _number(F.coalesce(x["discount"], F.lit(0.0)))]
    expected, actual = F.round(expected, 2), F.round(exact(end), 2)
    off = asked & start.isNotNull() & end.isNotNull() & (F.abs(expected - actual) > F.lit("0.05").cast("decimal(4,2)"))
    code, text = WARNINGS[kind]
    pieces = text.split("{}")
    message = F.concat(F.lit(pieces[0]), *[c for value, piece in zip([*shown, _cents(expected), _number(actual)], pieces[1:]) for c in (value, F.lit(piece))])
    return documents.withColumn("warning", F.when(off, F.struct(F.lit(code).alias("code"), message.alias("message"))))


def _cents(x: Column) -> Column:
    """With two decimals."""
    return F.round(x, 2).cast("decimal(28,2)").cast("string")


def _number(x: Column) -> Column:
    """The shortest decimal digits with one behind the point at least: 10.0, 10.25."""
    plain = x.cast("decimal(28,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")

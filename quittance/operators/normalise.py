"""Raw statement rows to typed transactions: locale, date order, sides, misread amounts, currencies.

Raw rows: rec_id, source (bank or ledger), row_no, and as text date, description, reference, debit,
credit, amount, type, balance. What a document shows about its locale is gathered as aggregates and
joined back, so one plan serves many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import currency, dates, money, text

#: words of a type cell that name the side, and beginnings that suggest it (fixed values)
EXPLICIT_DEBIT = ("d", "dr", "db", "debit", "debit entry", "s", "soll", "af", "debe", "debito", "cargo")
EXPLICIT_CREDIT = ("c", "cr", "credit", "credit entry", "h", "haben", "bij", "haber", "credito", "abono")
DEBIT_STARTS = ("withdraw", "payment", "paid", "check", "cheque", "chq", "bill pmt", "purchase", "expense", "fee", "charge", "pos", "atm", "transfer out", "debit", "outgoing")
CREDIT_STARTS = ("deposit", "receipt", "received", "refund", "interest", "income", "transfer in", "credit", "salary", "payroll", "incoming")
AMOUNTS = ("debit", "credit", "amount", "balance")
DOCUMENT = ["rec_id", "source"]


def type_side(value: Column) -> tuple[Column, Column]:
    """The explicit and the suggested side of a type cell."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^a-z]+", " "))
    explicit = F.when(t.isin(*EXPLICIT_DEBIT), "debit").when(t.isin(*EXPLICIT_CREDIT), "credit")
    suggested = F.when(t.rlike(f"^({'|'.join(DEBIT_STARTS)})"), "debit").when(t.rlike(f"^({'|'.join(CREDIT_STARTS)})"), "credit")
    return explicit, F.when(explicit.isNull(), suggested)


def locale(rows: DataFrame) -> DataFrame:
    """Per document: decimal_comma and month_first (null without evidence)."""
    some = lambda f: F.bool_or(F.coalesce(*[F.when(f(F.col(c)), True) for c in AMOUNTS], F.lit(False)))
    g = rows.groupBy(*DOCUMENT).agg(
        some(money.comma_evidence).alias("comma"), some(money.dot_evidence).alias("dot"),
        F.bool_or(dates.day_first_evidence(F.col("date"))).alias("day"), F.bool_or(dates.month_first_evidence(F.col("date"))).alias("month"),
    )
    first = F.when(F.coalesce("day", F.lit(False)), False).when(F.coalesce("month", F.lit(False)), True)
    return g.select(*DOCUMENT, money.one_sided(F.col("comma"), F.col("dot")).alias("decimal_comma"), first.alias("month_first"))


def date_orders(rows: DataFrame, known: DataFrame, currencies: DataFrame, tolerance: int = 2) -> DataFrame:
    """rec_id, bank_month_first, ledger_month_first: where a document shows no order, the reading of both
    documents under which most ledger dates have a bank date within the tolerance; ties go to equal orders,
    then to the currency's custom (month first for USD). currencies: rec_id, currency.
    """
    default = F.coalesce(F.col("currency") == "USD", F.lit(False))
    told = known.join(currencies, "rec_id", "left").select("rec_id", "source", "month_first", default.alias("custom"))
    either = told.select("rec_id", "source", "custom", F.explode(F.when(F.col("month_first").isNotNull(), F.array("month_first")).otherwise(F.array("custom", ~F.col("custom")))).alias("mf"))
    b, l = (either.where(F.col("source") == s).select("rec_id", "custom", F.col("mf").alias(f"{s}_mf")) for s in ("bank", "ledger"))
    combos = b.join(l.drop("custom"), "rec_id")
    read = F.explode(F.array(*[F.struct(F.lit(m).alias("mf"), dates.parse_date(F.col("date"), F.lit(m)).alias("day")) for m in (False, True)])).alias("x")
    days = rows.select("rec_id", "source", read).select("rec_id", "source", "x.*").where("day is not null").groupBy("rec_id", "source", "mf", "day").count()
    spread = days.where("source = 'bank'").select("rec_id", F.col("mf").alias("bank_mf"), F.explode(F.sequence(F.date_sub("day", tolerance), F.date_add("day", tolerance))).alias("day")).distinct()
    ledger = days.where("source = 'ledger'").select("rec_id", F.col("mf").alias("ledger_mf"), "day", "count")
    scores = ledger.join(spread, ["rec_id", "day"]).groupBy("rec_id", "bank_mf", "ledger_mf").agg(F.sum("count").alias("score"))
    scored = combos.join(scores, ["rec_id", "bank_mf", "ledger_mf"], "left").fillna(0, ["score"])
    order = [F.desc("score"), F.desc(F.col("bank_mf") == F.col("ledger_mf")), F.desc(F.col("bank_mf") == F.col("custom")), F.desc(F.col("ledger_mf") == F.col("custom"))]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("rec_id").orderBy(*order))).where("rank = 1")
    return best.select("rec_id", F.col("bank_mf").alias("bank_month_first"), F.col("ledger_mf").alias("ledger_month_first"))


def transactions(rows: DataFrame, evidence: DataFrame, code: Column | None = None) -> DataFrame:
    """Typed rows with usable amounts: rec_id, source, row_no, id, date, amount, direction, reference, description, tokens, balance.

    evidence: locale() rows. A single amount counts only where debit and credit are both missing; its side is
    the type cell's, else its Dr or Cr mark's, else debit below zero, else the type's suggestion, else credit.
    """
    r = rows.join(evidence, DOCUMENT, "left")
    parse = lambda c: money.parse_amount(F.col(c), F.col("decimal_comma"), code)
    r = r.withColumns({"d": parse("debit"), "c": parse("credit"), "a": parse("amount"), "b": parse("balance")})
    explicit, suggested = type_side(F.col("type"))
    mark = money.amount_marker(F.col("amount"))
    side = F.coalesce(explicit, F.when(mark == "dr", "debit").when(mark == "cr", "credit"), F.when(F.col("a") < 0, "debit"), suggested, F.lit("credit"))
    single = F.col("d").isNull() & F.col("c").isNull() & F.col("a").isNotNull()
    debit = F.when(single & (side == "debit"), F.col("a")).otherwise(F.col("d"))
    credit = F.when(single & (side == "credit"), F.col("a")).otherwise(F.col("c"))
    r = r.withColumn("net", (F.abs(F.coalesce(credit, F.lit(0))) - F.abs(F.coalesce(debit, F.lit(0)))).cast(money.MONEY)).where("net != 0")
    overdrawn = (F.col("source") == "bank") & (money.amount_marker(F.col("balance")) == "dr")
    reference = F.nullif(F.trim("reference"), F.lit(""))
    return r.select(
        "rec_id", "source", "row_no", F.concat(F.when(F.col("source") == "bank", "B").otherwise("L"), F.col("row_no").cast("string")).alias("id"),
        dates.parse_date(F.col("date"), F.col("month_first")).alias("date"), F.abs("net").cast(money.MONEY).alias("amount"), F.when(F.col("net") > 0, "credit").otherwise("debit").alias("direction"),
        text.normal_reference(reference).alias("reference"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), text.tokens(F.col("description")).alias("tokens"),
        F.when(F.coalesce(overdrawn, F.lit(False)), -F.abs("b")).otherwise(F.col("b")).alias("balance"),
    )


def row_warnings(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """Per document: rows without usable amount and typed rows without date."""
    all_rows = rows.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("n"))
    used = typed.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("used"), F.count_if(F.col("date").isNull()).alias("undated"))
    joined = all_rows.join(used, DOCUMENT, "left").fillna(0)
    return joined.select(*DOCUMENT, (F.col("n") - F.col("used")).alias("skipped"), "undated")


def bound_currencies(headers: DataFrame) -> DataFrame:
    """rec_id, currency, issue: the pair's currency; differing ones are an error, shared symbols and unknown codes warnings.

    headers: rec_id, source, currency (as printed).
    """
    code = currency.normal_currency(F.col("currency"))
    said = F.trim("currency") != ""
    issue = F.when(said & code.isNull(), F.when(currency.is_shared(F.col("currency")), "shared_symbol").otherwise("unknown_currency"))
    h = headers.withColumns({"code": code, "issue": issue})
    side = lambda s: F.max(F.when(F.col("source") == s, F.col("code")))
    g = h.groupBy("rec_id").agg(side("bank").alias("b"), side("ledger").alias("l"), F.min("issue").alias("warning"))
    differs = F.col("b").isNotNull() & F.col("l").isNotNull() & (F.col("b") != F.col("l"))
    return g.select("rec_id", F.when(~differs, F.coalesce("b", "l")).alias("currency"), F.when(differs, "currencies_differ").otherwise(F.coalesce("warning", F.when(F.coalesce("b", "l").isNull(), "no_currency"))).alias("issue"))


def period_overlap(typed: DataFrame, tolerance: int = 2) -> DataFrame:
    """rec_id, overlaps: whether the documents' periods meet within the tolerance (null without dates)."""
    side = lambda s, f: f(F.when(F.col("source") == s, F.col("date")))
    g = typed.groupBy("rec_id").agg(side("bank", F.min).alias("b0"), side("bank", F.max).alias("b1"), side("ledger", F.min).alias("l0"), side("ledger", F.max).alias("l1"))
    return g.select("rec_id", ~((F.col("l1") < F.date_sub("b0", tolerance)) | (F.col("l0") > F.date_add("b1", tolerance))).alias("overlaps"))


FULL_DATE, DAY_MONTH = r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$", r"^\d{1,2}\.\d{1,2}$"


def printed_numbers(texts: DataFrame) -> DataFrame:
    """rec_id, source, token: numbers printed in raw_text that are no full dates, without group spaces."""
    found = F.regexp_extract_all("raw_text", F.lit("\\d[\\d.,'  ]*\\d"), F.lit(0))
    tokens = texts.select(*DOCUMENT, F.explode(found).alias("token")).where(~F.col("token").rlike(FULL_DATE))
    return tokens.select(*DOCUMENT, F.regexp_replace("token", "['  ]", "").alias("token"))


def printed_convention(numbers: DataFrame) -> DataFrame:
    """The decimal mark by vote: three votes at least, and four times the other's."""
    comma = F.col("token").rlike(r"\d,\d{2}$|\.\d{3},\d+$")
    dot = ~comma & F.col("token").rlike(r"\d\.\d{2}$|,\d{3}\.\d+$") & ~F.col("token").rlike(DAY_MONTH)
    g = numbers.groupBy(*DOCUMENT).agg(F.count_if(comma).alias("c"), F.count_if(dot).alias("d"))
    mark = F.when((F.col("c") >= 3) & (F.col("c") >= 4 * F.col("d")), True).when((F.col("d") >= 3) & (F.col("d") >= 4 * F.col("c")), False)
    return g.select(*DOCUMENT, mark.alias("decimal_comma")).where("decimal_comma is not null")


def misreadings(token: Column, decimal_comma: Column) -> Column:
    """What a printed amount gives when its marks are read the wrong way: digits only, decimals dropped, groups taken as decimals."""
    dec, grp = F.when(decimal_comma, ",").otherwise("."), F.when(decimal_comma, ".").otherwise(",")
    whole = F.split_part(token, dec, F.lit(1))
    groups = F.length(token) - F.length(F.replace(token, grp))
    wrong = F.array(F.regexp_replace(token, r"\D", ""), F.replace(whole, grp, F.lit("")))
    grouped = F.array(F.replace(F.replace(token, dec, F.lit("")), grp, F.lit(".")), F.replace(whole, grp, F.lit(".")))
    texts = F.when(groups <= 1, F.concat(wrong, grouped)).otherwise(wrong)
    return F.array_distinct(F.transform(texts, lambda t: F.round(t.try_cast("decimal(38,9)"), 2).cast(money.MONEY)))


def corrections(values: DataFrame, texts: DataFrame) -> DataFrame:
    """Extracted amounts that are printed nowhere but misread exactly one printed amount.

    values: rec_id, source, row_no, field, value (typed); texts: rec_id, source, raw_text (a row a
    document, or a row a page, so that no task needs the whole text of a large document). Out: with `corrected`.
    """
    numbers = printed_numbers(texts)
    numbers = numbers.join(printed_convention(numbers), DOCUMENT)
    printed = numbers.withColumn("printed", money.parse_amount(F.col("token"), F.col("decimal_comma"))).where("printed is not null")
    wrong = printed.where(~F.col("token").rlike(DAY_MONTH)).select(*DOCUMENT, "printed", F.explode(misreadings(F.col("token"), F.col("decimal_comma"))).alias("magnitude"))
    fixes = wrong.where("magnitude is not null and magnitude != printed").groupBy(*DOCUMENT, "magnitude").agg(F.count_distinct("printed").alias("n"), F.min("printed").alias("fixed")).where("n = 1")
    asked = values.where("value is not null and value != 0").withColumn("magnitude", F.abs("value").cast(money.MONEY))
    missing = asked.join(printed.select(*DOCUMENT, F.col("printed").alias("magnitude")).distinct(), [*DOCUMENT, "magnitude"], "left_anti")
    sign = F.when(F.col("value") < 0, -1).otherwise(1)
    return missing.join(fixes, [*DOCUMENT, "magnitude"]).select(*values.columns, (F.col("fixed") * sign).cast(money.MONEY).alias("corrected"))

"""One reconciliation from end to end, and its report: numbered sections of text rows, as lines of CSV or sheets.

Inputs: bank and ledger as in matching, with description and perhaps balance and original_reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import guarded, minor_units, money_text
from ..session import cut
from . import matching, prefix

#: sections in order, with their headers (fixed values)
SECTIONS = (
    ("Summary", ()),
    ("Balance Verification", ()),
    ("Matched", ("Bank ID", "Bank Date", "Bank Description", "Bank Reference", "Ledger ID", "Ledger Date", "Ledger Description", "Ledger Reference", "Amount", "Flow", "Date Diff (days)", "Match Basis", "Confidence")),
    ("Unmatched Bank", ("ID", "Row", "Date", "Description", "Reference", "Debit", "Credit", "Balance", "Flow", "Reason")),
    ("Unmatched Ledger", ("ID", "Row", "Date", "Description", "Reference", "Debit", "Credit", "Balance", "Flow", "Reason")),
    ("Possible Duplicates", ("Source", "Transaction IDs", "Date", "Amount", "Count", "Reason")),
    ("Amount Mismatches", ("Type", "Bank ID", "Bank Date", "Bank Description", "Bank Amount", "Ledger ID", "Ledger Date", "Ledger Description", "Ledger Amount", "Difference", "Reason")),
    ("Amount Corrections", ("Source", "Transaction ID", "Field", "Extracted", "Corrected")),
    ("Warnings", ("Warning",)),
)
#: columns whose cells are numbers in a sheet (fixed values)
AMOUNTS = ("Amount", "Debit", "Credit", "Balance", "Bank Amount", "Ledger Amount", "Difference", "Extracted", "Corrected")
#: labels of the summary (fixed values)
SUMMARY = {
    "currency": "Currency", "bank_transactions": "Bank transactions", "ledger_transactions": "Ledger transactions", "amount_corrections": "OCR amount corrections", "matched": "Matched", "unmatched_bank": "Unmatched bank",
    "unmatched_ledger": "Unmatched ledger", "possible_duplicates": "Possible duplicate groups", "amount_mismatches": "Amount / direction mismatches", "amount_decimal_places": "Amount decimal places",
    "date_tolerance_days": "Date tolerance (days)", "description_matching": "Description matching", "ledger_direction_convention": "Ledger debit/credit convention",
}
#: warnings of every reconciliation (fixed values)
BOOK_NOTE = "The business ledger uses book-keeping convention (ledger debit = money into the bank); debit/credit directions were interpreted accordingly."
DISCREPANCY_NOTE = "Discrepancies usually reflect timing differences, bank charges, or data-entry differences. They are not, by themselves, evidence of fraud or an accounting error."
ROWS = ("rec_id", "section_no", "row_no", "cells")


def projected(rows: DataFrame, currency: Column | None = None) -> DataFrame:
    """Rows as they are shown: the amount under its side, dates in ISO form, empty texts as null. rows: with flow."""
    amount = money_text(F.col("amount"), currency)
    balance = money_text(F.col("balance"), currency) if "balance" in rows.columns else F.lit(None).cast("string")
    reference = F.col("original_reference" if "original_reference" in rows.columns else "reference")
    return rows.select(
        "rec_id", "row_no", "id", F.col("date").cast("string").alias("date"), F.nullif("description", F.lit("")).alias("description"), F.nullif(reference, F.lit("")).alias("reference"),
        *[F.when(F.col("direction") == d, amount).alias(d) for d in ("debit", "credit")], amount.alias("amount"), "flow", balance.alias("balance"), *[c for c in ("reason",) if c in rows.columns],
    )


def mismatch_reason(kind: Column, linked: Column, b_amount: Column, l_amount: Column, b_flow: Column, l_flow: Column, currency: Column | None = None) -> Column:
    link = F.concat(F.lit("Linked by "), F.when(linked, "same reference").otherwise("similar description and date"), F.lit("; "))
    text = lambda c: money_text(c, currency)
    turned = F.concat(link, F.lit("amount "), text(b_amount), F.lit(" agrees but the bank records money "), b_flow, F.lit(" while the ledger records money "), l_flow, F.lit("."))
    both = F.concat(F.lit(" Direction also differs (bank: money "), b_flow, F.lit(", ledger: money "), l_flow, F.lit(")."))
    differs = F.concat(
        link, F.lit("bank amount "), text(b_amount), F.lit(" differs from ledger amount "), text(l_amount), F.lit(" by "), text(F.abs(b_amount - l_amount)), F.lit("."),
        F.when(kind == "amount_and_direction_mismatch", both).otherwise(""),
    )
    return F.when(kind == "direction_mismatch", turned).otherwise(differs)


def reconciled(bank: DataFrame, ledger: DataFrame, tolerance: int = 2, descriptions: bool = True) -> dict[str, DataFrame]:
    """Every part of a reconciliation: convention, matched, mismatches, unmatched_bank, unmatched_ledger (with reasons), duplicates, summary.

    Rows of mismatched pairs are not unmatched. Reconciliations without bank rows or without ledger rows have no summary.
    What all parts read, the pairs of either kind and the conventions, is written once by checkpoints; calling this runs them.
    """
    both = matching.exact_matches(bank, ledger, tolerance, descriptions)
    convention = cut(matching.chosen_convention(bank, ledger, both))
    pairs = cut(both.join(convention.select("rec_id", "convention"), ["rec_id", "convention"]).withColumn("confidence", matching.confidence(F.col("score"))))
    wrong = cut(matching.mismatched(matching.unmatched(bank, pairs, "b"), matching.unmatched(ledger, pairs, "l"), convention, tolerance, descriptions))
    places = ("rec_id", "b_row_no", "l_row_no")
    used = pairs.select(*places).unionByName(wrong.select(*places))
    b = bank.withColumn("flow", matching.flow(F.col("direction")))
    l = ledger.join(convention.select("rec_id", "convention"), "rec_id").withColumn("flow", matching.flow(F.col("direction"), F.col("convention"))).drop("convention")

    def left(rows, others, side, other):
        rest = matching.unmatched(rows, used, side)
        near = matching.nearest_same_amount(rest, others).drop("id")
        reason = matching.unmatched_reason(F.col("near_days"), F.col("near_id"), F.col("near_date"), tolerance, other)
        return rest.join(near, ["rec_id", "row_no"]).withColumn("reason", reason).drop("near_id", "near_date", "near_days")

    parts = {"convention": convention, "matched": pairs, "mismatches": wrong, "unmatched_bank": left(b, l, "b", "ledger"), "unmatched_ledger": left(l, b, "l", "bank statement")}
    group = lambda df, source: matching.duplicates(df).withColumn("source", F.lit(source))
    parts["duplicates"] = group(bank, "bank").unionByName(group(ledger, "ledger"))
    count = lambda df, name: df.groupBy("rec_id").agg(F.count(F.lit(1)).alias(name))
    total = convention.select("rec_id", F.col("convention").alias("ledger_direction_convention"))
    counted = {"bank_transactions": bank, "ledger_transactions": ledger, "matched": pairs, "possible_duplicates": parts["duplicates"], "amount_mismatches": wrong}
    for name, df in counted.items():
        total = total.join(count(df, name), "rec_id", "left")
    total = cut(total.fillna(0, list(counted)))
    rest = lambda name: (F.col(name) - F.col("matched") - F.col("amount_mismatches"))
    parts["summary"] = total.select("*", rest("bank_transactions").alias("unmatched_bank"), rest("ledger_transactions").alias("unmatched_ledger"), F.lit(tolerance).alias("date_tolerance_days"), F.lit(descriptions).alias("description_matching"))
    return parts


#: what rows of all sections are sorted by: a text, a number, a text
_ORDER = ("by_text", "by_number", "by_field")


def _section(rows: DataFrame, title: str, cells: list, number: str | Column, text: str | None = None, field: str | None = None, after: int = 1) -> DataFrame:
    """Rows of a section with what they are sorted by; they are numbered with those of all sections, behind `after` rows."""
    at = [t for t, _ in SECTIONS].index(title) + 1
    by = [F.col(text) if text else F.lit(""), (F.col(number) if isinstance(number, str) else number).cast("bigint"), F.col(field) if field else F.lit("")]
    return rows.select("rec_id", F.lit(at).alias("section_no"), F.lit(after).cast("bigint").alias("after"), *[c.alias(n) for c, n in zip(by, _ORDER)], F.array(*[c.cast("string") for c in cells]).alias("cells"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of _section numbered in one pass over ranges, so that no section of a large reconciliation is a task of its own."""
    placed = prefix.numbered(rows, ["rec_id", "section_no"], list(_ORDER), "place")
    return placed.select("rec_id", "section_no", (F.col("after") + F.col("place")).cast("bigint").alias("row_no"), "cells")


def _listed(rows: DataFrame, title: str, lines: list[list]) -> DataFrame:
    """Rows of a section that every reconciliation has once."""
    number = [t for t, _ in SECTIONS].index(title) + 1
    made = F.array(*[F.array(*[(F.lit(c) if isinstance(c, str) else c).cast("string") for c in line]) if line else F.array().cast("array<string>") for line in lines])
    return rows.select("rec_id", F.lit(number).alias("section_no"), F.posexplode(made).alias("place", "cells")).select("rec_id", "section_no", (F.col("place") + 2).cast("bigint").alias("row_no"), "cells")


def report(records: DataFrame, bank: DataFrame, ledger: DataFrame, parts: dict[str, DataFrame], balances: DataFrame | None = None, breaks: DataFrame | None = None, corrections: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """The report's rows: rec_id, section_no, row_no, cells. Row 0 is the title, row 1 the header where the section has one.

    records: rec_id, reconciliation_id, bank_file, ledger_file, created_at, completed_at (texts), currency; parts: reconciled().
    balances: rec_id and, for bank_ and ledger_, opening, opening_source, closing, calculated, difference, status, running_status,
    checked, breaks; book_status, closing_difference, opening_difference, explained, unexplained (null for all where not given).
    breaks: rec_id, source (Bank, Ledger), row_no, id, date, expected, balance, difference. corrections: rec_id, source, id, row_no, field,
    extracted, corrected. warnings: rec_id, place, warning; they come before those of the reconciliation itself. Every section
    has its title, also without rows.
    """
    money = lambda c: money_text(F.col(c), F.col("currency"))
    coded = records.select("rec_id", "currency")
    known = lambda df: df.join(coded, "rec_id", "left")
    b, l = (df.withColumn("flow", matching.flow(F.col("direction"))) for df in (bank, ledger))
    side = lambda df, letter: projected(df).select("rec_id", *[F.col(c).alias(f"{letter}_{c}") for c in ("row_no", "date", "description", "reference")])
    shown = lambda pairs: known(pairs.join(side(b, "b"), ["rec_id", "b_row_no"]).join(side(l, "l"), ["rec_id", "l_row_no"]))
    col = lambda *names: [F.col(n) for n in names]

    summed = records.join(parts["summary"], "rec_id").withColumns({"amount_decimal_places": minor_units(F.coalesce("currency", F.lit(""))), "amount_corrections": F.lit(0).cast("bigint")})
    if corrections is not None:
        n = corrections.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_corrections"))
        summed = summed.join(n, "rec_id", "left").withColumn("amount_corrections", F.coalesce("n_corrections", F.lit(0)))
    told = F.when(F.col("description_matching"), "True").otherwise("False")
    facts = [["Reconciliation ID", F.col("reconciliation_id")], ["Bank statement", F.col("bank_file")], ["Business ledger", F.col("ledger_file")], ["Created at", F.coalesce("created_at", F.lit(""))], ["Completed at", F.coalesce("completed_at", F.lit(""))]]
    facts += [[label, told if name == "description_matching" else F.col(name)] for name, label in SUMMARY.items()]
    sections, numbered = [_listed(summed, "Summary", facts)], []

    fields = ("opening", "opening_source", "closing", "calculated", "difference", "status", "running_status", "checked", "breaks")
    whole = ("opening", "closing", "calculated", "difference", "closing_difference", "opening_difference", "explained", "unexplained")
    checked = known(parts["convention"].select("rec_id"))
    checked = checked.join(balances, "rec_id", "left") if balances is not None else checked
    have = lambda c: (money(c) if c.removeprefix("bank_").removeprefix("ledger_") in whole else F.col(c)) if balances is not None and c in balances.columns else F.lit(None)
    named = ("Opening balance", "Opening balance source", "Closing balance", "Calculated closing balance", "Difference", "Closing balance check", "Running balance check", "Running balance rows checked", "Running balance breaks")
    checks = [["Metric", "Bank statement", "Business ledger"], *[[t, have(f"bank_{f}"), have(f"ledger_{f}")] for t, f in zip(named, fields)], []]
    book = (("Book-to-bank check", "book_status"), ("Closing balance difference (bank - ledger)", "closing_difference"), ("Opening balance difference (bank - ledger)", "opening_difference"), ("Explained by discrepancies", "explained"), ("Unexplained difference", "unexplained"))
    checks += [*[[t, have(f)] for t, f in book], [], ["Running balance breaks", "Transaction", "Date", "Expected", "Stated", "Difference"]]
    sections.append(_listed(checked, "Balance Verification", checks))
    if breaks is not None:
        broken = _section(known(breaks), "Balance Verification", [*col("source", "id", "date"), money("expected"), money("balance"), money("difference")], "row_no", "source", after=len(checks) + 1)
        numbered.append(broken)

    m = shown(parts["matched"])
    numbered.append(_section(m, "Matched", [*col("b_id", "b_date", "b_description", "b_reference", "l_id", "l_date", "l_description", "l_reference"), money("amount"), *col("flow", "dd"), F.replace("basis", F.lit(","), F.lit(", ")), F.col("confidence")], "b_row_no"))
    for name, title in (("unmatched_bank", "Unmatched Bank"), ("unmatched_ledger", "Unmatched Ledger")):
        rest = projected(known(parts[name]), F.col("currency"))
        numbered.append(_section(rest, title, col("id", "row_no", "date", "description", "reference", "debit", "credit", "balance", "flow", "reason"), "row_no"))
    label = F.when(F.col("source") == "bank", "bank statement").otherwise("business ledger")
    shared = F.concat(F.col("n").cast("string"), F.lit(" "), label, F.lit(" entries share the same date ("), F.col("date").cast("string"), F.lit("), amount ("), money("amount"), F.lit("), direction, description and reference. Nothing was removed; please review."))
    numbered.append(_section(known(parts["duplicates"]), "Possible Duplicates", [F.col("source"), F.replace("ids", F.lit(","), F.lit(", ")), F.col("date"), money("amount"), F.col("n"), shared], "first_row", "source"))
    w = parts["mismatches"].join(b.select("rec_id", F.col("row_no").alias("b_row_no"), F.col("amount").alias("b_amount"), F.col("flow").alias("b_flow")), ["rec_id", "b_row_no"])
    w = w.join(ledger.join(parts["convention"].select("rec_id", "convention"), "rec_id").select("rec_id", F.col("row_no").alias("l_row_no"), F.col("amount").alias("l_amount"), matching.flow(F.col("direction"), F.col("convention")).alias("l_flow")), ["rec_id", "l_row_no"])
    w = shown(w).withColumns({"b_signed": matching.signed(F.col("b_amount"), F.col("b_flow")), "l_signed": matching.signed(F.col("l_amount"), F.col("l_flow"))})
    why = mismatch_reason(F.col("kind"), F.col("linked"), *col("b_amount", "l_amount", "b_flow", "l_flow"), F.col("currency"))
    numbered.append(_section(w, "Amount Mismatches", [*col("kind", "b_id", "b_date", "b_description"), money("b_signed"), *col("l_id", "l_date", "l_description"), money("l_signed"), money("difference"), why], "b_row_no"))
    if corrections is not None:
        numbered.append(_section(corrections, "Amount Corrections", col("source", "id", "field", "extracted", "corrected"), "row_no", "source", "field"))

    some = (F.col("unmatched_bank") + F.col("unmatched_ledger") + F.col("amount_mismatches") + F.col("possible_duplicates")) > 0
    note = lambda place, when, said: F.struct(F.lit(1).alias("late"), F.lit(place).alias("place"), F.when(when, said).alias("warning"))
    own = F.array(note(1, F.col("ledger_direction_convention") == "book", BOOK_NOTE), note(2, some, DISCREPANCY_NOTE))
    notes = parts["summary"].select("rec_id", F.explode(own).alias("x")).select("rec_id", "x.*")
    if warnings is not None:
        notes = notes.unionByName(warnings.select("rec_id", F.lit(0).alias("late"), F.col("place").cast("int").alias("place"), "warning"))
    numbered.append(_section(notes.where("warning is not null").withColumn("late", F.col("late").cast("string")), "Warnings", col("warning"), "place", "late"))
    together = numbered[0]
    for s in numbered[1:]:
        together = together.unionByName(s)
    sections.append(_numbered(together))

    heads = F.array(*[F.struct(F.lit(n).alias("section_no"), F.lit(r).cast("bigint").alias("row_no"), F.array(*map(F.lit, cells)).alias("cells")) for n, (title, header) in enumerate(SECTIONS, 1) for r, cells in ((0, [title]), (1, header)) if cells])
    out = parts["convention"].select("rec_id", F.explode(heads).alias("x")).select("rec_id", "x.*")
    for s in sections:
        out = out.unionByName(s)
    return out.select(*ROWS)


def csv_lines(rows: DataFrame) -> DataFrame:
    """The report's rows as lines of CSV: rec_id, section_no, row_no, line. Titles stand after ##, cells that a sheet would run are guarded.

    An empty line ends a section: a file has it before every title but the first, which begins with the byte order mark.
    """
    cell = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.array_join(F.transform("cells", lambda c: cell(F.coalesce(F.when(F.col("row_no") > 1, guarded(c)).otherwise(c), F.lit("")))), ",")
    title = F.concat(F.when(F.col("section_no") > 1, "\n").otherwise("\ufeff"), F.lit("## "), F.element_at("cells", 1))
    return rows.select("rec_id", "section_no", "row_no", F.when(F.col("row_no") == 0, title).otherwise(line).alias("line"))


def number_format(currency: Column) -> Column:
    """The format of a sheet's amounts: groups, and as many decimals as the currency has."""
    units = minor_units(currency)
    return F.when(units == 0, "#,##0").otherwise(F.concat(F.lit("#,##0."), F.repeat(F.lit("0"), units)))

"""The reconciliation report against plain loops, and its optional parts by cases."""

import csv
import io
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from quittance import catalog
from quittance.operators import matching, reports
from quittance.plans import driver_data

SF = "/root/testdata/sf0.001"
TOLERANCE = 2


def _linked(a, b):
    if not a or not b:
        return False
    if a == b:
        return len(a) >= 3 or not a.isdigit()
    short, long = sorted((a, b), key=len)
    return len(short) >= 6 and short in long


def _similar(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def _gap(b, l):
    return None if b["date"] is None or l["date"] is None else abs((b["date"] - l["date"]).days)


def _chosen(edges):
    used, out = set(), []
    for e in sorted(edges, key=lambda e: (-e[0], 999 if e[1] is None else e[1], e[2]["row_no"], e[3]["row_no"])):
        if ("b", e[2]["id"]) not in used and ("l", e[3]["id"]) not in used:
            used |= {("b", e[2]["id"]), ("l", e[3]["id"])}
            out.append(e)
    return sorted(out, key=lambda e: e[2]["row_no"])


def _flow(row, book=False):
    return "in" if (row["direction"] == "credit") != book else "out"


def _exact(bank, ledger, book):
    edges = []
    for b in bank:
        for l in ledger:
            dd = _gap(b, l)
            if b["amount"] == l["amount"] and _flow(b) == _flow(l, book) and (dd is None or dd <= TOLERANCE):
                linked, sim = _linked(b["reference"], l["reference"]), _similar(b["tokens"], l["tokens"])
                score = (80 if dd is None else 100 + max(0, 30 - 5 * dd)) + 50 * linked + int(sim * 40)
                when = "date_unavailable" if dd is None else "same_date" if dd == 0 else f"date_within_{dd}_day{'s' if dd > 1 else ''}"
                edges.append((score, dd, b, l, ["amount", when, *(["reference"] if linked else []), *(["description"] if sim >= 0.5 else [])]))
    return _chosen(edges)


def _wrong(bank, ledger, book):
    edges = []
    for b in bank:
        for l in ledger:
            dd, linked, sim = _gap(b, l), _linked(b["reference"], l["reference"]), _similar(b["tokens"], l["tokens"])
            same_amount, same_flow = b["amount"] == l["amount"], _flow(b) == _flow(l, book)
            close = abs(b["amount"] - l["amount"]) * 5 <= max(b["amount"], l["amount"])
            if (dd is None and not (b["reference"] and b["reference"] == l["reference"])) or (dd is not None and dd > TOLERANCE) or (same_amount and same_flow):
                continue
            if same_amount:
                kind = "direction_mismatch" if linked or sim >= 0.5 else None
            else:
                kind = ("amount_mismatch" if same_flow else "amount_and_direction_mismatch") if linked or (sim >= 0.6 and close) else None
            if kind:
                edges.append((100 * linked + int(sim * 40) - 5 * (dd or 0), dd, b, l, (kind, linked)))
    return _chosen(edges)


def _reason(row, others, flow, other_flow, other):
    same = [o for o in others if o["amount"] == row["amount"] and other_flow(o) == flow(row)]
    dated = sorted((o for o in same if o["date"]), key=lambda o: (o["date"], o["row_no"]))
    if not same:
        return f"No {other} entry with the same amount and direction was found."
    if row["date"] and dated:
        before, after = [o for o in dated if o["date"] < row["date"]][-1:], [o for o in dated if o["date"] >= row["date"]][:1]
        near = min(before + after, key=lambda o: (abs((o["date"] - row["date"]).days), o["row_no"]))
        days = abs((near["date"] - row["date"]).days)
        if days > TOLERANCE:
            return f"Closest {other} entry with the same amount ({near['id']}, {near['date']}) is {days} days apart, outside the ±{TOLERANCE}-day tolerance."
    return f"The {other} entries with the same amount and direction were already matched to other transactions."


def _report(bank, ledger, places):
    text = lambda x: "" if x is None else str(x.quantize(Decimal(1).scaleb(-places)))
    shown = lambda r: [r["id"], str(r["date"] or ""), r["description"], r["reference"]]
    ways = [_exact(bank, ledger, book) for book in (False, True)]
    book = len(ways[1]) - len(ways[0]) >= max(2, min(len(bank), len(ledger)) // 10)
    pairs = ways[book]
    rest = lambda rows, found, at: [r for r in rows if r["id"] not in {e[at]["id"] for e in found}]
    wrong = _wrong(rest(bank, pairs, 2), rest(ledger, pairs, 3), book)
    l_flow = lambda r: _flow(r, book)
    signed = lambda r, f: r["amount"] if f(r) == "in" else -r["amount"]
    sections = defaultdict(list)
    for score, dd, b, l, basis in pairs:
        sections[3].append([*shown(b), *shown(l), text(b["amount"]), _flow(b), "" if dd is None else str(dd), ", ".join(basis), "high" if score >= 150 else "medium" if score >= 120 else "low"])
    for n, rows, others, at, flow, other_flow, other in ((4, bank, ledger, 2, _flow, l_flow, "ledger"), (5, ledger, bank, 3, l_flow, _flow, "bank statement")):
        for r in sorted(rest(rows, pairs + wrong, at), key=lambda r: r["row_no"]):
            sides = [text(r["amount"]) if r["direction"] == d else "" for d in ("debit", "credit")]
            sections[n].append([r["id"], str(r["row_no"]), *shown(r)[1:], *sides, "", flow(r), _reason(r, others, flow, other_flow, other)])
    for source, label, rows in (("bank", "bank statement", bank), ("ledger", "business ledger", ledger)):
        groups = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["row_no"]):
            if r["date"]:
                groups[r["date"], r["amount"], r["direction"], tuple(r["tokens"]), r["reference"]].append(r)
        for g in groups.values():
            if len(g) > 1:
                why = f"{len(g)} {label} entries share the same date ({g[0]['date']}), amount ({text(g[0]['amount'])}), direction, description and reference. Nothing was removed; please review."
                sections[6].append([source, ", ".join(r["id"] for r in g), str(g[0]["date"]), text(g[0]["amount"]), str(len(g)), why])
    for _, _, b, l, (kind, linked) in wrong:
        why = "Linked by " + ("same reference" if linked else "similar description and date") + "; "
        if kind == "direction_mismatch":
            why += f"amount {text(b['amount'])} agrees but the bank records money {_flow(b)} while the ledger records money {l_flow(l)}."
        else:
            why += f"bank amount {text(b['amount'])} differs from ledger amount {text(l['amount'])} by {text(abs(b['amount'] - l['amount']))}."
            why += f" Direction also differs (bank: money {_flow(b)}, ledger: money {l_flow(l)})." if kind == "amount_and_direction_mismatch" else ""
        sections[7].append([kind, *shown(b)[:3], text(signed(b, _flow)), *shown(l)[:3], text(signed(l, l_flow)), text(signed(b, _flow) - signed(l, l_flow)), why])
    sections[9] = [[w] for w in ([reports.BOOK_NOTE] if book else []) + ([reports.DISCREPANCY_NOTE] if any(sections[n] for n in (4, 5, 6, 7)) else [])]
    counts = [len(bank), len(ledger), 0, len(pairs), len(sections[4]), len(sections[5]), len(sections[6]), len(wrong), places, TOLERANCE]
    return sections, counts, "book" if book else "bank"


def _cells(lines, section):
    rows = sorted((r for r in lines if r["section_no"] == section and r["row_no"] > 1), key=lambda r: r["row_no"])
    return list(csv.reader(io.StringIO("\n".join(r["line"] for r in rows))))


def _sides(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["rec_id"]].append(r.asDict())
    return out


def _hold(lines, bank, ledger, places):
    sections, counts, convention = _report(bank, ledger, places)
    for n in (3, 4, 5, 6, 7, 9):
        assert _cells(lines, n) == sections[n], n
    facts = dict(_cells(lines, 1))
    assert [facts[reports.SUMMARY[k]] for k in ("bank_transactions", "ledger_transactions", "amount_corrections", "matched", "unmatched_bank", "unmatched_ledger", "possible_duplicates", "amount_mismatches", "amount_decimal_places", "date_tolerance_days")] == [str(c) for c in counts]
    assert facts["Ledger debit/credit convention"] == convention


def test_query_against_loops(spark):
    lines = defaultdict(list)
    for r in catalog.queries()["recon_report"](spark, SF).collect():
        lines[r["rec_id"]].append(r)
    bank, ledger = (_sides(driver_data.normalised(df)) for df in (driver_data.bank(spark, SF), driver_data.ledger(spark, SF)))
    assert set(lines) == set(bank) & set(ledger) and len(lines) > 20
    for rec, got in lines.items():
        _hold(got, bank[rec], ledger[rec], 2 if rec % 2 == 0 else 3)


def test_contested_undated_and_given_parts(spark):
    schema = "rec_id long, row_no long, id string, date string, amount string, direction string, reference string, description string"
    typed = lambda rows: driver_data.normalised(spark.createDataFrame(rows, schema).withColumns({"date": F.col("date").cast("date"), "amount": F.col("amount").cast("decimal(28,3)")}))
    b = typed([
        (1, 1, "B1", "2026-01-01", "10", "debit", "", "rent"), (1, 2, "B2", "2026-01-02", "10", "debit", "", "rent"), (1, 3, "B3", None, "10", "debit", "", "rent"), (1, 4, "B4", None, "77", "credit", "", "x, \"y\""),
        (1, 5, "B5", "2026-01-20", "10", "debit", "", "rent"), (1, 6, "B6", "2026-02-01", "50", "credit", "INV123456", "sale"), (1, 7, "B7", None, "5", "credit", "", "late"),
    ])
    l = typed([
        (1, 1, "L1", "2026-01-02", "10", "debit", "", "rent"), (1, 2, "L2", "2026-01-03", "10", "debit", "", "rent"), (1, 3, "L3", None, "5", "debit", "", "=late"), (1, 4, "L4", "2026-02-02", "55", "debit", "INV123456", "sale"),
        (1, 5, "L5", "2026-03-01", "5", "credit", "", "late"), (1, 6, "L6", "2026-02-01", "5", "credit", "", "late"),
    ])
    record = spark.createDataFrame([(1, "R", "b", "l", None, None, "USD")], "rec_id long, reconciliation_id string, bank_file string, ledger_file string, created_at string, completed_at string, currency string")
    extra = {
        "balances": spark.createDataFrame([(1, Decimal(7), "stated", "passed", 2, Decimal(-3))], "rec_id long, bank_opening decimal(28,3), bank_opening_source string, ledger_status string, bank_breaks int, unexplained decimal(28,3)"),
        "breaks": spark.createDataFrame([(1, "Ledger", 2, "L2", "2026-01-03", Decimal(1), Decimal(2), Decimal(1)), (1, "Bank", 9, "B9", None, Decimal(1), Decimal(2), Decimal(1))], "rec_id long, source string, row_no long, id string, date string, expected decimal(28,3), balance decimal(28,3), difference decimal(28,3)"),
        "corrections": spark.createDataFrame([(1, "bank", "B1", 1, "debit", "1.00", "10.00")], "rec_id long, source string, id string, row_no long, field string, extracted string, corrected string"),
        "warnings": spark.createDataFrame([(1, 1, "first"), (1, 2, "second")], "rec_id long, place int, warning string"),
    }
    lines = reports.csv_lines(reports.report(record, b, l, reports.reconciled(b, l, TOLERANCE), **extra)).collect()
    bank, ledger = _sides(b)[1], _sides(l)[1]
    sections, _, _ = _report(bank, ledger, 2)
    for n in (3, 4, 5, 6, 7):
        assert _cells(lines, n) == [[f"'{c}" if c.startswith("=") else c for c in row] for row in sections[n]], n
    assert [w[0] for w in _cells(lines, 9)][:2] == ["first", "second"] and _cells(lines, 9)[-1] == [reports.DISCREPANCY_NOTE]
    assert _cells(lines, 8) == [["bank", "B1", "debit", "1.00", "10.00"]] and dict(_cells(lines, 1))["OCR amount corrections"] == "1"
    checks = _cells(lines, 2)
    assert checks[1] == ["Opening balance", "7.00", ""] and checks[2] == ["Opening balance source", "stated", ""] and checks[6] == ["Closing balance check", "", "passed"] and ["Unexplained difference", "-3.00"] in checks
    assert checks[-2:] == [["Bank", "B9", "", "1.00", "2.00", "1.00"], ["Ledger", "L2", "2026-01-03", "1.00", "2.00", "1.00"]]


def test_number_formats(spark):
    df = spark.createDataFrame([("JPY",), ("EUR",), ("KWD",)], "c string").select(reports.number_format(F.col("c")))
    assert [r[0] for r in df.collect()] == ["#,##0", "#,##0.00", "#,##0.000"]

"""Operators on small inputs: contention, ties, missing values."""

import io
import random
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from quittance.operators import analytics, balances, documents, matching
from quittance.sources import exports, sniff, spreadsheet
from quittance.streaming import jobs as stream

TX = "rec_id long, row_no long, id string, date date, amount decimal(28,3), direction string, reference string, tokens array<string>"


def rows(spark, letter, data):
    made = [(1, i, f"{letter}{i}", d, Decimal(a), s, r, t) for i, (d, a, s, r, t) in enumerate(data, 1)]
    return spark.createDataFrame(made, TX)


def day(n):
    import datetime

    return datetime.date(2026, 1, 1) + datetime.timedelta(days=n)


def brute_greedy(bank, ledger, tolerance):
    edges = []
    for i, (bd, ba, bs, br, bt) in enumerate(bank, 1):
        for j, (ld, la, ls, lr, lt) in enumerate(ledger, 1):
            dd = None if bd is None or ld is None else abs((bd - ld).days)
            if ba != la or bs != ls or dd is not None and dd > tolerance:
                continue
            score = (80 if dd is None else 100 + max(0, 30 - 5 * dd)) + (50 if br and br == lr else 0)
            both, either = set(bt) & set(lt), set(bt) | set(lt)
            score += int(40 * (len(both) / len(either) if bt and lt else 0))
            edges.append((-score, 999 if dd is None else dd, i, j))
    used_b, used_l, out = set(), set(), []
    for _, _, i, j in sorted(edges):
        if i not in used_b and j not in used_l:
            used_b.add(i)
            used_l.add(j)
            out.append((i, j))
    return sorted(out)


def test_assignment_under_contention(spark):
    r = random.Random(11)
    one = lambda: (None if r.random() < 0.1 else day(r.randrange(8)), r.choice(["5", "7"]), r.choice(["debit", "credit"]), r.choice(["", "REFA", "REFB"]), r.sample(["aa", "bb", "cc"], r.randrange(3)))
    for _ in range(3):
        bank, ledger = [one() for _ in range(25)], [one() for _ in range(25)]
        pairs = matching.exact_matches(rows(spark, "B", bank), rows(spark, "L", ledger), 2).where("convention = 'bank'")
        assert sorted((x["b_row_no"], x["l_row_no"]) for x in pairs.collect()) == brute_greedy(bank, ledger, 2)


def test_book_convention(spark):
    bank = [(day(k), str(10 + k), "credit", "", []) for k in range(5)]
    ledger = [(d, a, "debit", r, t) for d, a, _, r, t in bank]
    b, l = rows(spark, "B", bank), rows(spark, "L", ledger)
    assert matching.matched(b, l).select("convention").distinct().collect()[0][0] == "book" and matching.matched(b, l).count() == 5


def test_running_balance_like_a_loop(spark):
    r = random.Random(4)
    data, want, prev = [], [], Decimal(100)
    for i in range(1, 61):
        amount, credit = Decimal(r.randrange(1, 50)), r.random() < 0.5
        expected = prev + (amount if credit else -amount)
        stated = None if r.random() < 0.3 else expected + (1 if r.random() < 0.2 else 0)
        if stated is not None and stated != expected:
            want.append((f"B{i}", expected, stated))
        prev = expected if stated is None else stated
        data.append((1, i, f"B{i}", day(i), amount, "credit" if credit else "debit", stated))
    df = spark.createDataFrame(data, "rec_id long, row_no long, id string, date date, amount decimal(28,3), direction string, balance decimal(28,3)")
    opening = spark.createDataFrame([(1, Decimal(100))], "rec_id long, opening decimal(28,3)")
    got = balances.breaks(balances.running(df, opening)).orderBy("row_no").collect()
    assert [(x["id"], x["expected"], x["balance"]) for x in got] == want
    turned = df.withColumn("row_no", 61 - F.col("row_no"))
    assert balances.breaks(balances.running(turned, opening)).count() == len(want)


def test_merge_takes_first_and_last(spark):
    parts = spark.createDataFrame([(1, 0, "", None, 5, "a"), (1, 1, "T", 3, None, ""), (1, 2, "U", 4, 9, "b")], "doc_id long, part int, title string, opening long, closing long, summary string")
    assert tuple(documents.merged_parts(parts).first()) == (1, "T", 3, 9, "a\n\nb", 3)


def test_parts_keep_all_lines(spark):
    text = "\n".join("x" * n for n in (5, 5, 30, 1, 2, 8))
    got = documents.parts_of(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 12).orderBy("doc_id", "part").collect()
    assert "\n".join(r["text"] for r in got if r["doc_id"] == 1) == text and max(len(r["text"]) for r in got if r["part"] != 1) <= 30


def test_dedup_first_wins(spark):
    data = [(2, 1, "2026-01-01", "x", "r", Decimal(1), None), (1, 5, "2026-01-01", "x", "r", Decimal(1), None), (1, 6, "2026-01-01", "y", "r", Decimal(1), None)]
    df = spark.createDataFrame(data, "doc_id long, row_no long, date string, description string, reference string, debit decimal(10,2), credit decimal(10,2)")
    assert sorted((r["doc_id"], r["row_no"]) for r in analytics.deduplicated(df).collect()) == [(1, 5), (1, 6)]


BANK_CSV = "Statement of account;;;\nTxn Date;Narration;Withdrawal Amt;Deposit Amt;Balance\n;Opening Balance;;;1.000,00\n01/02/2026;ACME\n;more text;;;\n02/02/2026;Shop;12,50;;987,50\n;Total;12,50;;\n"


def xlsx_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Date</t></si><si><t>Amount</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>46296</v></c><c r="C2"><v>5.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet/>")
    return out.getvalue()


def test_spreadsheets(spark):
    html = b"<html><table><tr><th>Date</th><th>Debit</th><th>Credit</th></tr><tr><td>1/2/2026</td><td colspan=2>7<br>x</td></tr></table>"
    xml = b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet><Table><Row><Cell><Data>Date</Data></Cell><Cell ss:Index="3"><Data>Amount</Data></Cell></Row><Row><Cell><Data>1/2/2026</Data></Cell><Cell ss:Index="3"><Data>9</Data></Cell></Row></Table></Worksheet></Workbook>'
    wide = "Date\tAmount\n1/2/2026\t3".encode("utf-16")
    files = spark.createDataFrame([("a.csv", bytearray(BANK_CSV.encode())), ("b.xls", bytearray(html)), ("c.xml", bytearray(xml)), ("d.csv", bytearray(xlsx_bytes())), ("e.txt", bytearray(wide)), ("f.bin", bytearray(bytes(200)))], "path string, content binary")
    kinds = {r["path"]: r["k"] for r in files.select("path", sniff.kind_of(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.csv": "csv", "b.xls": "html", "c.xml": "xml", "d.csv": "xlsx", "e.txt": "csv", "f.bin": None}
    read = spreadsheet.read_rows(files)
    got = {(r["path"], r["row_no"]): r for r in spreadsheet.transactions(read).collect()}
    assert got["a.csv", 4]["description"] == "ACME more text" and got["a.csv", 6]["debit"] == "12,50" and ("a.csv", 7) not in got
    assert got["b.xls", 2]["debit"] == "7 x" and got["c.xml", 2]["amount"] == "9" and got["d.csv", 2]["amount"] == "5.5" and got["e.txt", 2]["amount"] == "3"
    assert spreadsheet.edge_balances(read).where("path = 'a.csv'").first()["opening"] == "1.000,00"


def sheet(spark, path, content):
    return spreadsheet.read_rows(spark.createDataFrame([(path, bytearray(content))], "path string, content binary"))


def test_spreadsheet_edges(spark):
    """Opening and closing rows, page totals, repeated headers, the order of stated values."""
    text = "Date,Débit-,CREDIT,Particulars,Amount\n,5,6,* Brought forward:,7\n1/2/2026,3,,Shop,\n,,,- Page total,9\n Date ,débit,Credit,particulars,AMOUNT\n2/2/2026,,4,More,\n,,,Carried Forward,8\n"
    rows = sheet(spark, "a", text.encode())
    assert [(r["row_no"], r["description"], r["debit"], r["credit"]) for r in spreadsheet.transactions(rows).orderBy("row_no").collect()] == [(3, "Shop", "3", None), (6, "More", None, "4")]
    edges = spreadsheet.edge_balances(rows).first()
    assert (edges["opening"], edges["closing"]) == ("5", "8")


def test_broken_files_end_no_job(spark):
    nested = b"<table><tr><td>Date</td><td>Amount</td></tr><tr><td>1/2/2026<table><tr><td>in</td></tr></table></td><td>5</td></tr></table><table><tr><td>z</td></tr></table>"
    files = [("a.xlsx", xlsx_bytes()[:200]), ("b.xml", b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet"><Row>'), ("d.html", nested)]
    rows = spreadsheet.read_rows(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"))
    assert {r["sheet"] for r in rows.collect()} == {"table 1", "table 2", "table 3", None} and [r["amount"] for r in spreadsheet.transactions(rows).collect()] == ["5"]
    assert {(r["path"], r["error"]) for r in spreadsheet.unreadable(rows).collect()} == {("a.xlsx", spreadsheet.UNREADABLE["xlsx"]), ("b.xml", spreadsheet.UNREADABLE["xml"])}
    names = [s for of in spreadsheet.SYNONYMS.values() for s in of]
    assert len(names) == len(set(names))


def read(spark, files, **options):
    return spreadsheet.read_rows(spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary"), **options)


def test_sheets_limits_and_errors(spark):
    """The first sheet with a header, limits per sheet, long cells, error rows."""
    table = lambda rows: "<Worksheet><Table>" + "".join("<Row>" + "".join(f"<Cell><Data>{c}</Data></Cell>" for c in r) + "</Row>" for r in rows) + "</Table></Worksheet>"
    book = lambda *tables: f'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet">{"".join(map(table, tables))}</Workbook>'.encode()
    html = "".join("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in t) + "</table>" for t in ([["Date", "Amount"], ["1/1/2026", "1"]], [["Date", "Amount"], ["2/1/2026", "2"]]))
    long = "Date,Amount,Note\n1/1/2026,5,%s\n" % ("n" * 200_000)
    files = {
        "two.html": html.encode(), "second.xml": book([["Title"]], [["Date", "Amount"], ["3/1/2026", "3"]]), "long.csv": long.encode(), "many.csv": ("Date,Amount\n" + "1/1/2026,1\n" * 12).encode(),
        "many.xml": book([["x"]] * 5, [["Date", "Amount"]] * 14), "late.xml": book([["Date", "Amount"], ["4/1/2026", "4"]])[:-25], "old.xls": bytes.fromhex("D0CF11E0A1B11AE1") + bytes(600), "none.csv": b"a,b\nc,d\n", "noise": bytes(range(256)) * 9, "empty": b"",
    }
    rows = read(spark, files, max_rows=12)
    assert sorted((r["path"], r["amount"]) for r in spreadsheet.transactions(rows).collect()) == [("long.csv", "5"), ("second.xml", "3"), ("two.html", "1")]
    said = {r["path"]: r["error"] for r in spreadsheet.problems(rows).collect()}
    u = spreadsheet.UNREADABLE
    assert said == {"many.csv": "CSV exceeds the maximum of 12 rows.", "many.xml": "Spreadsheet exceeds the maximum of 12 rows.", "late.xml": u["xml"], "old.xls": u["xls"], "none.csv": spreadsheet.NO_HEADER, "noise": u[None], "empty": u[None]}
    few = read(spark, {"two.html": html.encode()}, sheets=1, columns=1).collect()
    assert [(r["sheet_no"], list(r["cells"])) for r in few] == [(1, ["Date"]), (1, ["1/1/2026"])]


def test_headers_and_hints(spark):
    split = b"Voucher,Date,Particulars,Amount,\n,,,Debit,Credit\nv,01/02/2026,Shop,3,\nVoucher,Date,Particulars,Amount,,\n"
    dated = b"Date,Amount,x\n01/02/2026,Debit,Credit\n"
    plain = b"When,What,How much\n01/02/2026,Shop,3\n"
    rows = read(spark, {"split": split, "dated": dated, "plain": plain, "bare": plain})
    hints = spark.createDataFrame([("plain", 0, 0, {"date": 0, "amount": 2}), ("bare", 0, -1, {"date": 0, "debit": 2, "credit": None}), ("split", 0, -1, {"date": 0, "amount": 0}), ("dated", 5, 0, {"date": 0, "amount": 1})], "path string, sheet int, header_row int, columns map<string,int>")
    found = {r["path"]: (r["header_row"], r["columns"]) for r in spreadsheet.headers(rows, hints).collect()}
    assert found == {"split": (2, {"date": 1, "description": 2, "debit": 3, "credit": 4}), "dated": (1, {"date": 0, "amount": 1}), "plain": (1, {"date": 0, "amount": 2}), "bare": (0, {"date": 0, "debit": 2})}
    got = sorted((r["path"], r["row_no"], r["amount"], r["debit"]) for r in spreadsheet.transactions(rows, hints).collect())
    assert got == [("bare", 1, None, "How much"), ("bare", 2, None, "3"), ("dated", 2, "Debit", None), ("plain", 2, "3", None), ("split", 3, None, "3")]
    assert {r["path"] for r in spreadsheet.problems(rows, hints).collect()} == set() and {r["path"] for r in spreadsheet.problems(rows).collect()} == {"plain", "bare"}


def test_active_sheet_first(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx_bytes())) as old, zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            data = old.read(n).decode()
            z.writestr(n, data.replace("<sheets>", '<bookViews><workbookView activeTab="1"/></bookViews><sheets>').replace(' state="hidden"', ""))
    rows = read(spark, {"a": out.getvalue()}).collect()
    assert {(r["sheet_no"], r["sheet"]) for r in rows} == {(2, "S")} and len(rows) == 2


def test_exports(spark):
    data = [(1, 1, "2026-01-05", "Netflix <a>", "R", Decimal("9.99"), None), (1, 2, "2026-01-06", "Pay", None, None, Decimal("50.00"))]
    df = spark.createDataFrame(data, "doc_id long, row_no long, date string, description string, reference string, debit decimal(10,2), credit decimal(10,2)")
    entries = exports.signed_rows(df)
    qif = [r["line"] for r in exports.qif_lines(entries).orderBy("line_no").collect()]
    assert qif == ["!Type:Bank", "D01/05/2026", "T-9.99", "PNetflix <a>", "NR", "LEntertainment & Subscriptions", "^", "D01/06/2026", "T50.00", "PPay", "LMiscellaneous", "^"]
    heads = spark.createDataFrame([(1, "usd", "A & B bank", "12-34", Decimal("7.5"))], "doc_id long, currency string, bank_name string, account string, closing decimal(10,2)")
    ofx = [r["line"].strip() for r in exports.ofx_lines(entries, heads, "20260301000000", qbo=True).orderBy("line_no").collect()]
    wanted = ("<INTU.BID>3000", "<DTPOSTED>20260105120000", "<TRNTYPE>DEBIT", "<CURDEF>USD", "<BANKID>ABBANK", "<ACCTID>1234", "<DTSTART>20260105120000", "<DTEND>20260106120000", "<BALAMT>7.50", "<MEMO>Miscellaneous", "<TRNUID>1")
    assert all(x in ofx for x in wanted) and ofx[-1] == "</OFX>" and ofx.count("<STMTTRN>") == 2
    import hashlib

    assert f"<FITID>{hashlib.md5(b'1_2_20260106120000_50.0_Pay').hexdigest()[:16].upper()}" in ofx
    items = spark.createDataFrame([(5, 1, "", 2.0, 3.0, None, None), (5, 2, "Pen", None, None, 4.0, 9.0)], "doc_id long, row_no long, description string, quantity double, unit_price double, amount double, total double")
    docs = spark.createDataFrame([(5, "2026/1/9", "N1")], "doc_id long, date string, number string")
    assert [r["line"] for r in exports.qif_lines(exports.signed_items(items, docs)).orderBy("line_no").collect()][1:5] == ["D01/09/2026", "T-6.00", "PLine Item", "NN1"]
    grid = spark.createDataFrame([([["a", "b"], ["1"], ["a", "b"], ["x|y", "2"]],)], "g array<array<string>>")
    assert grid.select(exports.markdown(F.col("g"))).first()[0] == "| a | b |\n| --- | --- |\n| 1 |  |\n| x\\|y | 2 |"


def test_rate_limit_like_a_loop(spark, tmp_path):
    import datetime

    r = random.Random(8)
    start = datetime.datetime(2026, 1, 1)
    data = [(r.choice("ab"), start + datetime.timedelta(seconds=s), i) for i, s in enumerate(sorted(r.sample(range(400), 60)))]
    spark.createDataFrame(data, "client string, ts timestamp, request_id long").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("client string, ts timestamp, request_id long").parquet(f"{tmp_path}/in")
    query = stream.rate_limited(source, 5, 60).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {x["request_id"]: x["allowed"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    times, want = {"a": [], "b": []}, {}
    for client, ts, i in data:
        times[client] = [t for t in times[client] if t > ts - datetime.timedelta(seconds=60)]
        want[i] = len(times[client]) < 5
        if want[i]:
            times[client].append(ts)
    assert got == want


def test_files_are_parsed_once(spark, tmp_path):
    """Whatever is asked of the rows, their file is opened once."""
    opened = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([("a.csv", bytearray(BANK_CSV.encode())), ("b.csv", bytearray(b"a,b\nc,d\n"))], "path string, content binary").coalesce(1)
    rows = spreadsheet.read_rows(files.mapInArrow(counted, files.schema))
    assert spreadsheet.transactions(rows).count() > 0 and [r["path"] for r in spreadsheet.problems(rows).collect()] == ["b.csv"]
    assert spreadsheet.edge_balances(rows).count() >= 0 and opened.value <= 4  # a checkpoint may compute its rows twice

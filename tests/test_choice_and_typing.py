"""The split choice of pairs against the sequential one, and lenient typing of JSON."""

from pyspark.sql import functions as F

from quittance.operators import lenient, matching
from quittance.plans import driver_data as data

SF = "/root/testdata/sf0.001"


def test_rounds_choose_like_one_pass(spark):
    bank, ledger = map(data.normalised, data.contested(spark, SF))
    edges = matching.exact_edges(bank, ledger, 2).withColumn("rec_id", F.lit(1)).cache()
    key = ["rec_id", "convention"]  # whole tables contend
    whole = sorted(map(tuple, matching.greedy(edges, key).collect()))
    split = sorted(map(tuple, matching.greedy(edges, key, most_edges=40).collect()))
    assert whole == split and len(whole) > 200
    used, best = set(), []
    for e in sorted(edges.collect(), key=lambda e: (e["convention"], -e["score"], 999 if e["dd"] is None else e["dd"], e["b_row_no"], e["l_row_no"])):
        ends = {(e["convention"], "b", e["b_row_no"]), (e["convention"], "l", e["l_row_no"])}
        if not ends & used:
            used |= ends
            best.append(tuple(e))
    assert whole == sorted(best)
    chosen, rest = matching.mutual_round(edges, key)
    assert 0 < chosen.count() < len(whole) and rest.columns == edges.columns
    edges.unpersist()


def test_typing(spark):
    schema = "n double, name string, day date, items array<struct<a: int>>, party struct<id: string>"
    texts = ['{"n": 1, "name": "x", "day": "2026-01-02", "items": [{"a": 1}], "party": {"id": "7", "more": 1}, "other": 5}', '{"n": "2.5", "name": 3, "day": "soon", "items": {}, "party": []}', '{"n": null}', "{}", "[1]", "7", '{"n": 1', '{\n "n": }', "", None, '{"n": [1]}', '{"n": "many"}']
    got = lenient.typed(spark.createDataFrame([(k, t, "v") for k, t in enumerate(texts)], "k int, json string, extra string"), schema).orderBy("k").collect()
    first = got[0]
    assert first["value"]["n"] == 1.0 and str(first["value"]["day"]) == "2026-01-02" and first["value"]["items"][0]["a"] == 1 and first["value"]["party"]["id"] == "7" and first["warning"] is None and first["json"] == texts[0]
    assert got[1]["value"]["n"] == 2.5 and got[1]["deviating"] == ["name", "day", "items", "party"] and got[1]["warning"]["code"] == lenient.DEVIATES
    assert got[2]["warning"] is None and got[3]["warning"] is None and got[3]["value"]["n"] is None
    assert [got[k]["warning"]["code"] for k in (4, 5)] == [lenient.DEVIATES] * 2 and got[4]["value"] is None
    assert [(got[k]["warning"]["code"], got[k]["warning"]["line"], got[k]["warning"]["column"]) for k in (6, 7, 8)] == [(lenient.BROKEN, 1, 8), (lenient.BROKEN, 2, 7), (lenient.BROKEN, 1, 1)]
    assert got[9]["value"] is None and got[9]["warning"] is None and got[10]["deviating"] == ["n"] and got[11]["deviating"] == ["n"]


def test_labels_and_invoice_lines(spark):
    from quittance.operators import documents

    text = "Invoice # A-77\nInvoice date: 2026-01-05\nMerchant:  Corner Shop\n| Description | Qty | Sum |\n|---|---|---|\n| Pen | 3 x | EUR 4.50 |\n| Ink | many | 1,200.00 |\n| Short | 9.99 |\n| Free | 1 | none |\n|  | Gap | 2 | 7.00 |\nTotal: $ 1,204.50"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, ""), (4, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in documents.labelled(docs, "invoice").collect()}
    assert (got[1]["invoice_number"], got[1]["invoice_date"], got[1]["total"]) == ("A-77", "2026-01-05", 1204.5) and all(got[k]["total"] is None for k in (2, 3, 4))
    assert documents.labelled(docs, "receipt").first()["merchant"] == "Corner Shop"
    lines = documents.invoice_lines(docs).orderBy("line_no").collect()
    assert [(r["description"], r["quantity"], r["amount"]) for r in lines] == [("Pen", 3.0, 4.5), ("Ink", 1.0, 1200.0), ("Gap", 2.0, 7.0)]

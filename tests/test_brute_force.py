"""Whole results of the queries without SQL against plain loops."""

import hashlib
import re
from collections import defaultdict
from decimal import Decimal

from quittance import catalog
from quittance.functions.text import STOPWORDS

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_mismatches(spark):
    """Greedy choice among all candidates of each reconciliation, best score first."""
    candidates = defaultdict(list)
    for r in run(spark, "recon_mismatch_candidates"):
        candidates[r["rec_id"]].append(r)
    want = []
    for edges in candidates.values():
        used = set()
        for r in sorted(edges, key=lambda r: (-r["score"], r["dd"], int(r["b_id"][1:]), int(r["l_id"][1:]))):
            if r["b_id"] not in used and r["l_id"] not in used:
                used |= {r["b_id"], r["l_id"]}
                want.append(tuple(r))
    got = [tuple(r) for r in run(spark, "recon_mismatches")]
    assert sorted(got) == sorted(want) and got


def test_space(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for r in docs:
        text = r["text"].replace(". ", ".\t  \n\n\n")
        lines = [re.sub(r"[ \t]+", " ", x).strip(" ") for x in text.split("\n")]
        want[r["doc_id"]] = hashlib.md5(re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(" \t\n\x0b\f\r").encode()).hexdigest()
    assert {r["doc_id"]: r["clean"] for r in run(spark, "whitespace_norm")} == want


def test_parts(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        parts = []
        for line in r["text"].split("\n"):
            if parts and (parts[-1] == "" or len(parts[-1]) + len(line) + 1 <= 2000):
                parts[-1] = line if parts[-1] == "" else f"{parts[-1]}\n{line}"
            else:
                parts.append(line)
        want += [(r["doc_id"], k, len(p)) for k, p in enumerate(parts)]
    assert sorted(map(tuple, run(spark, "text_parts"))) == sorted(want)


def test_rate_limit(spark):
    times, want = defaultdict(list), {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        client = str(r["user_id"] % 5)
        times[client] = [t for t in times[client] if (r["ts"] - t).total_seconds() < 600]
        want[r["event_id"]] = (client, len(times[client]) < 5)
        if want[r["event_id"]][1]:
            times[client].append(r["ts"])
    assert {r["request_id"]: (r["client"], r["allowed"]) for r in run(spark, "stream_rate_limit")} == want


def test_misread(spark):
    """Every amount of a thousand or more was read without its marks; one is mended where only one printed amount gives it."""
    rows = [(r["o_custkey"] % 50, r["o_orderkey"] + 1, Decimal(str(r["o_totalprice"])).quantize(Decimal("0.01"))) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    got = {(r["rec_id"], r["row_no"]): r["corrected"] for r in run(spark, "misread_amounts")}
    printed = defaultdict(set)
    for rec, _, amount in rows:
        if amount >= 1000:
            printed[rec].add(amount)
    want = {(rec, row): float(amount) for rec, row, amount in rows if amount >= 1000}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 0.005 for k in got) and len(got) > 0.95 * len(want)


def test_xml_round_trip_of_all(spark):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        lines[r["l_orderkey"]].append((r["l_linenumber"], r["l_partkey"], Decimal(str(r["l_extendedprice"])).quantize(Decimal("0.01"))))
    got = run(spark, "einvoice_xml_round_trip")
    assert len(got) == len(lines) and STOPWORDS
    for r in got:
        of = lines[r["doc_id"]]
        first = min((str(n), f"Part <{p}>") for n, p, _ in of)[1]
        assert (r["n_lines"], r["first_line"], r["invoice_number"]) == (len(of), first, f"R{r['doc_id']}") and abs(r["line_total"] - float(sum(x for *_, x in of))) < 0.005

"""Archives against a plain loop over the ledger."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from quittance.operators import archive

RANDOM = random.Random(4)


def text(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def walk(lines):
    """Problems of each line."""
    out, before = [], "0" * 64
    for n, line in enumerate(lines, 1):
        told = []
        try:
            entry = json.loads(line)
            own = entry.pop("entry_hash")
        except (ValueError, KeyError, AttributeError, TypeError):
            out.append([f"Ledger line {n} is unreadable"])
            before = None
            continue
        if sha(text(entry)) != own:
            told.append(f"Ledger entry {n} was modified")
        if before is not None and entry.get("prev_hash") != before:
            told.append(f"Ledger chain is broken at entry {n} (entry deleted, inserted or reordered)")
        out.append(told)
        before = own
    return out


def archives(spark, n):
    rows = [("main", k, f"ea_{k}", f"2026-01-{k % 28 + 1:02d}T00:00:00+00:00", "validate", None if k % 3 else f"Nr. é \"{k}\"", f"o{k % 2}" if k % 5 else None, [("xml", f"../dir/inv oice{k}.xml", bytearray(f"<x>{k}</x>".encode()), "text/xml"), ("pdf", "", bytearray(b"p"), "application/pdf")]) for k in range(n)]
    return spark.createDataFrame(rows, "chain string, seq bigint, archive_id string, archived_at string, operation string, invoice_number string, owner_id string, files array<struct<role: string, filename: string, content: binary, content_type: string>>")


def test_seals_and_links(spark):
    manifests = archive.sealed(archives(spark, 40)).cache()
    for r in manifests.collect():
        files = [{"role": f["role"], "filename": s["filename"], "sha256": sha(bytes(f["content"])), "size": len(f["content"]), "content_type": f["content_type"]} for f, s in zip(r["files"], r["stored"])]
        assert r["core"] == text({k: r[k] for k in ("archive_id", "archived_at", "operation", "invoice_number", "owner_id")} | {"files": files}) and r["manifest_sha256"] == sha(r["core"])
        assert [s["filename"] for s in r["stored"]] == [f"00_xml__inv_oice{r['seq']}.xml", "01_pdf__file"]
    lines = [r["line"] for r in archive.linked(manifests).orderBy("seq").collect()]
    assert len(lines) == 40 and walk(lines) == [[]] * 40
    more = archive.linked(manifests.withColumn("seq", F.col("seq") + 100), spark.createDataFrame([("main", json.loads(lines[-1])["entry_hash"])], "chain string, entry_hash string"))
    assert walk(lines + [r["line"] for r in more.orderBy("seq").collect()]) == [[]] * 80
    manifests.unpersist()


def test_damaged_ledgers(spark):
    lines = [r["line"] for r in archive.linked(archive.sealed(archives(spark, 60))).orderBy("seq").collect()]
    for _ in range(3):
        held = list(lines)
        for _ in range(8):
            k = RANDOM.randrange(len(held))
            kind = RANDOM.randrange(7)
            if kind == 0:
                held.pop(k)
            elif kind == 1:
                held.insert(k, RANDOM.choice(["", "no json {", "[1]", '{"a":1}', "3", "null"]))
            elif kind == 2:
                held[k] = held[k].replace('"owner_id":', '"owner_id":"other","was":')
            elif kind == 3:
                held[k - 1], held[k] = held[k], held[k - 1]
            elif kind == 4:
                held[k] = held[k].replace(",", " , ")  # spaces do not matter
            elif kind == 5:
                held.insert(k, held[k])
        df = spark.createDataFrame([("main", n, x) for n, x in enumerate(held, 1)] + [("other", n, x) for n, x in enumerate(lines, 1)] + [("null", 1, None)], "chain string, line_no bigint, line string")
        got = {(r["chain"], r["line_no"]): r["problems"] for r in archive.checked(df, ranges=7).collect()}
        assert [got["main", n] for n in range(1, len(held) + 1)] == walk(held)
        assert all(got["other", n] == [] for n in range(1, 61)) and got["null", 1] == ["Ledger line 1 is unreadable"]


def test_verification(spark):
    manifests = archive.sealed(archives(spark, 8)).cache()
    ledger = archive.linked(manifests).cache()
    lines = ledger.withColumn("line_no", F.col("seq") + 1)
    whole = {}
    for r in manifests.join(ledger.select("archive_id", "prev_hash", "entry_hash"), "archive_id").collect():
        whole[r["archive_id"]] = json.loads(r["core"]) | {"manifest_sha256": r["manifest_sha256"], "prev_hash": r["prev_hash"], "entry_hash": r["entry_hash"]}
    whole["ea_1"]["operation"] = "create"
    whole["ea_2"]["entry_hash"] = "0"
    del whole["ea_3"]
    files = [(a, f["filename"], f["sha256"]) for a, m in whole.items() for f in m["files"]]
    files = [(a, n, "x" if a == "ea_4" and n.startswith("00") else h) for a, n, h in files if not (a == "ea_5" and n.startswith("01"))]
    texts = [(a, json.dumps(m, indent=2)) for a, m in whole.items()]
    checked = archive.checked(lines.where("archive_id <> 'ea_7'").withColumn("line_no", F.when(F.col("line_no") > 8, 0).otherwise(F.col("line_no"))))
    args = spark.createDataFrame(texts, "archive_id string, manifest string"), spark.createDataFrame(files, "archive_id string, filename string, sha256 string")
    got = {r["archive_id"]: (r["problems"], r["intact"], r["chain_problems"]) for r in archive.verified(*args, checked).collect()}
    assert got["ea_0"] == ([], True, 0) and got["ea_1"][0] == [archive.CHANGED] and got["ea_2"][0] == [archive.DIFFERS] and got["ea_3"][0] == [archive.DELETED]
    assert got["ea_4"][0] == ["Hash mismatch (file modified): 00_xml__inv_oice4.xml"] and got["ea_5"][0] == ["File missing: 01_pdf__file"] and got["ea_6"] == ([], True, 0) and got["ea_7"][0] == [archive.NO_ENTRY]
    manifests.unpersist(), ledger.unpersist()


def test_long_chains_are_linked_by_ranges(spark):
    """The same lines whether a chain is one task's or many ranges'; no task is given more than a range of a long chain."""
    row = lambda c, k: (c, k, f"{c}{k}", "2026-01-01", None if k % 3 else "o", f"m{k}")
    rows = [row(c, k) for c, n in (("long", 500), ("other", 230), ("short", 40), (None, 3)) for k in range(n)]
    manifests = spark.createDataFrame(rows[::-1], "chain string, seq long, archive_id string, archived_at string, owner_id string, manifest_sha256 string")
    last = spark.createDataFrame([("other", "f" * 64)], "chain string, entry_hash string")
    for of in (None, last):
        whole, parts = archive.linked(manifests, of), archive.linked(manifests, of, most=100)
        assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
        from_file = [f for f in parts.inputFiles() if "/linked/" in f]
        sizes = [spark.read.parquet(f).count() for f in from_file]
        assert len(sizes) >= 7 and max(sizes) <= 200


def test_lines_are_written_once_and_numbered_where_they_are_checked(spark):
    """Readers of a ledger do not link it again; lines by seq are numbered in the ranges in which they are checked; escapes are Python's."""
    odd = ["a", "b\u000b\u001f", 'c"\\u001F', "d\\u00AB", "e é\n", None, "\\"]
    rows = [("main", 3 * k, f"ea_{k}", odd[k % 7], odd[(k + 2) % 7], f"m{k}") for k in range(70)]
    manifests = spark.createDataFrame(rows, "chain string, seq long, archive_id string, archived_at string, owner_id string, manifest_sha256 string")
    for most in (1_000, 20):
        ledger = archive.linked(manifests, most=most)
        files = ledger.inputFiles()
        assert files and all("/linked/" in f for f in files)
        before = "0" * 64
        for of, r in zip(rows, ledger.orderBy("seq").collect(), strict=True):
            entry = dict(zip(("archive_id", "archived_at", "owner_id", "manifest_sha256"), of[2:])) | {"prev_hash": before}
            before = sha(text(entry))
            assert (r["seq"], r["line"]) == (of[1], text(entry | {"entry_hash": before}))
        kept = ledger.where("seq % 7 <> 3").select("chain", "seq", "line")
        numbered = kept.selectExpr("chain", "row_number() OVER (ORDER BY seq) AS line_no", "line")
        assert sorted(map(str, archive.checked(kept, 4).collect())) == sorted(map(str, archive.checked(numbered, 3).collect()))

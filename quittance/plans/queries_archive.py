"""Queries of archives: one ledger of all orders, damaged in places, checked and held against manifests and files; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import archive
from . import driver_data as data


def _sealed(spark, sf):
    """An archive per order with a file of its price; finished orders have no owner."""
    k = F.col("o_orderkey").cast("string")
    content = F.concat(k, F.lit(":"), F.col("o_totalprice").cast("string")).cast("binary")
    one = F.struct(F.lit("xml").alias("role"), F.concat(F.lit("order "), k, F.lit(".xml")).alias("filename"), content.alias("content"), F.lit("text/xml").alias("content_type"))
    return archive.sealed(data.load(spark, sf, "orders").select(
        F.lit("main").alias("chain"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("ea_"), k).alias("archive_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("archived_at"),
        F.col("o_orderpriority").alias("operation"), F.concat(F.lit("Nº "), k).alias("invoice_number"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("owner_id"), F.array(one).alias("files"),
    ))


def _damaged(linked):
    """The ledger's lines after an accident, still in order of seq: some gone, some garbled, some with another owner."""
    k = F.col("seq")
    line = F.when(k % 31 == 3, F.concat(F.lit("x"), F.col("line"))).when(k % 23 == 5, F.regexp_replace("line", '"owner_id":', '"owner_id":"other","was":')).otherwise(F.col("line"))
    return linked.where("seq % 37 != 4").select("chain", "seq", line.alias("line"))


def archive_ledger(spark: SparkSession, sf: str) -> DataFrame:
    checked = archive.checked(_damaged(archive.linked(_sealed(spark, sf))))
    return checked.select("line_no", "archive_id", F.array_join("problems", "; ").alias("problems"))


def archive_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Some manifests are gone or changed, some files are gone or others; the ledger is damaged."""
    manifests = _sealed(spark, sf)
    linked = archive.linked(manifests)
    checked = archive.checked(_damaged(linked))
    k = F.regexp_extract("archive_id", r"\d+", 0).cast("bigint")
    hashes = linked.select("archive_id", "prev_hash", "entry_hash")
    pair = lambda n: F.concat(F.lit(f',"{n}":"'), F.col(n), F.lit('"'))
    body = F.when(k % 13 == 2, F.replace("core", F.lit("Nº"), F.lit("No"))).otherwise(F.col("core"))
    whole = manifests.where(k % 11 != 7).join(hashes, "archive_id").select("archive_id", F.concat(F.rtrim(body, F.lit("}")), *map(pair, ("manifest_sha256", "prev_hash", "entry_hash")), F.lit("}")).alias("manifest"))
    # every archive is in the ledger as it was linked
    files = manifests.select("archive_id", F.explode("stored").alias("f")).select("archive_id", F.col("f.filename").alias("filename"), F.when(k % 19 == 6, "other").otherwise(F.col("f.sha256")).alias("sha256")).where(k % 17 != 9)
    found = archive.verified(whole, files, checked)
    return found.select("archive_id", F.array_join("problems", "; ").alias("problems"), "chain_problems", "intact")


QUERIES = (archive_ledger, archive_verification)

_LINES = f"""WITH o AS (SELECT o_orderkey AS k, lag(o_orderkey % 37 = 4) OVER (ORDER BY o_orderkey) AS gap FROM orders),
l AS (SELECT k, row_number() OVER (ORDER BY k) AS n, k % 31 = 3 AS bad, k % 23 = 5 AS other, coalesce(gap, FALSE) AS gap FROM o WHERE k % 37 <> 4),
c AS (SELECT *, coalesce(lag(bad) OVER (ORDER BY n), FALSE) AS reset FROM l),
p AS (SELECT k, n, bad, CASE WHEN bad THEN ['Ledger line ' || n || ' is unreadable'] ELSE list_filter([CASE WHEN other THEN 'Ledger entry ' || n || ' was modified' END, CASE WHEN gap AND NOT reset THEN 'Ledger chain is broken at entry ' || n || ' (entry deleted, inserted or reordered)' END], lambda x: x IS NOT NULL) END AS problems FROM c)"""
_FILE = "'00_xml__order_' || o_orderkey || '.xml'"
SQL = {
    "archive_ledger": f"{_LINES} SELECT n AS line_no, CASE WHEN NOT bad THEN 'ea_' || k END AS archive_id, array_to_string(problems, '; ') AS problems FROM p",
    "archive_verification": f"""{_LINES}, s AS (SELECT sum(len(problems))::BIGINT AS chain_problems FROM p),
v AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 7 AS there, p.k IS NOT NULL AND NOT bad AS listed, list_filter([CASE WHEN o_orderkey % 17 = 9 THEN 'File missing: ' || {_FILE} WHEN o_orderkey % 19 = 6 THEN 'Hash mismatch (file modified): ' || {_FILE} END,
  CASE WHEN o_orderkey % 13 = 2 THEN 'Manifest content does not match its recorded hash' END, CASE WHEN p.k IS NULL OR bad THEN 'No ledger entry found for this archive' END], lambda x: x IS NOT NULL) AS problems FROM orders LEFT JOIN p ON p.k = o_orderkey)
SELECT 'ea_' || k AS archive_id, array_to_string(CASE WHEN there THEN problems ELSE ['Archive directory or manifest was deleted'] END, '; ') AS problems, CASE WHEN listed THEN chain_problems ELSE 0 END AS chain_problems, there AND len(problems) = 0 AND (NOT listed OR chain_problems = 0) AS intact FROM v, s WHERE there OR listed""",
}

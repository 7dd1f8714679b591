"""Wall seconds of headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

import json
import os
import sys
import time

from quittance import catalog
from quittance.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
QUERIES = (
    "recon_exact_match", "recon_mismatches", "recon_nearest_reason", "recon_duplicates", "recon_summary", "running_balance_breaks", "direction_repair",
    "statement_kpis", "category_breakdown", "subscriptions", "dedup_ledger", "consolidated_monthly", "profit_and_loss", "vat_breakdown", "invoice_totals",
    "invoice_report", "job_stats", "report_page", "doc_classify", "doc_extract_lines", "part_merge", "archive_chain", "parse_amounts", "parse_dates", "ofx_rows", "qif_rows",
    "recon_contested", "merged_statements", "sheet_transactions", "archive_ledger",
)


def main() -> None:
    spark = session(f"local[{CPUS}]", **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": str(CPUS), "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = catalog.queries(), {}
    known["statement_kpis"](spark, SF).count()  # starts the executors and loads classes
    for name in QUERIES:
        began = time.time()
        known[name](spark, SF).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()  # no query profits from another's kept rows
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(os.path.basename(SF.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()

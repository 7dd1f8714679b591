"""Reconciliations with rows on one side only: the queries and their SQL agree."""

import pytest

from quittance import catalog

from .oracle import differences


@pytest.mark.parametrize("name", ["recon_convention", "recon_summary", "recon_unmatched_bank"])
def test_bank_rows_without_ledger(spark, tmp_path, name):
    # orders 3 and 13 have no ledger row, and their customer has no others
    rows = spark.sql("SELECT id AS o_orderkey, if(id % 10 = 3, 7L, 8L) AS o_custkey, 'O' AS o_orderstatus, 100.0D + id AS o_totalprice, timestamp'2024-01-05' AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(1, 15)")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert differences(spark, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name]) == ([], [])

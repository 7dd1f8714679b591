"""Every query with SQL agrees with DuckDB on the driver's smallest tables."""

import pytest

from quittance import catalog

from .oracle import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    assert differences(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name], con) == ([], [])


#: queries without SQL, each held against brute force in test_brute_force.py
ELSEWHERE = {"recon_mismatches", "recon_report", "whitespace_norm", "text_parts", "stream_rate_limit", "misread_amounts"}


def test_queries_without_sql_are_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == ELSEWHERE

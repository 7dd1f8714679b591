"""All registered queries of the library with their equivalent SQL."""

from __future__ import annotations

from .plans import queries_archive, queries_documents, queries_einvoices, queries_intake, queries_merging, queries_parsing, queries_recon, queries_records, queries_rules, queries_sheets, queries_streams

MODULES = (queries_recon, queries_documents, queries_streams, queries_parsing, queries_rules, queries_records, queries_intake, queries_merging, queries_sheets, queries_archive, queries_einvoices)


def queries() -> dict:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}

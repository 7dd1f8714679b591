"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def _cell(x):
    if x is None or x != x:
        return ""
    if isinstance(x, float):
        return f"{x:.6g}" if abs(x) < 1e-9 else f"{x:.9g}"
    text = str(x)
    return text.removesuffix(" 00:00:00")


def rows_of(pdf):
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pd.notna(pdf), None)
    return sorted(tuple(_cell(float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in r) for r in pdf.itertuples(index=False))


def differences(spark, sf_dir, query, sql, con=None):
    """(only in Spark, only in SQL), column names compared first."""
    got = query(spark, sf_dir).toPandas()
    want = (con or connection(sf_dir)).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return [sorted(got.columns)], [sorted(want.columns)]
    a, b = rows_of(got), rows_of(want)
    from collections import Counter

    left, right = Counter(a), Counter(b)
    return list((left - right).elements())[:5], list((right - left).elements())[:5]

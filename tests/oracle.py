"""Compare a registered query with its DuckDB statement on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf_dir):
    """(spark rows, first differences); the differences are empty when both results agree."""
    df = query(spark, sf_dir)
    got_cols, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = table_of(names, cur.fetchall())
    diffs = []
    if got_cols != want_cols:
        diffs.append(("columns", got_cols, want_cols))
    if len(got) != len(want):
        diffs.append(("rows", len(got), len(want)))
    a, b = set(got), set(want)
    diffs += [("only spark", r) for r in sorted(a - b)[:3]] + [("only sql", r) for r in sorted(b - a)[:3]]
    return got, diffs

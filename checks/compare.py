"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(value)


def _rows(columns, rows):
    """Columns by name, rows as comparable text in one order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = ([_plain(row[i]) for i in order] for row in rows)
    return [columns[i] for i in order], sorted(plain, key=lambda row: [str(x) for x in row])


def compare(name, query, sql, spark, con, folder):
    """(problem or None, rows, seconds)"""
    start = time.time()
    df = query(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return None if got[1] else "no rows", len(got[1]), spent
    cursor = con.execute(sql)
    want = _rows([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), spent
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}", len(got[1]), spent
    different = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if different:
        return f"{len(different)} rows differ, e.g. {different[0]}", len(got[1]), spent
    if not got[1]:
        return "no rows on either side", 0, spent
    return None, len(got[1]), spent

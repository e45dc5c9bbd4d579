"""Compare a registered query with its SQL run by DuckDB over the same files."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (float(f"{value:.9g}"))
    if isinstance(value, int):
        return float(f"{value}") if abs(value) < 2**53 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return rows_of(columns, result.fetchall())


def difference(df, con, sql) -> str | None:
    """None when both agree, else what differs."""
    left_columns, left = spark_rows(df)
    right_columns, right = duck_rows(con, sql)
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if left == right:
        return None
    ls, rs = set(map(repr, left)), set(map(repr, right))
    return f"rows {len(left)} vs {len(right)}; only spark {sorted(ls - rs)[:4]}; only sql {sorted(rs - ls)[:4]}"

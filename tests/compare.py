"""Run a named analysis in Spark and its SQL statement in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS FROM '{Path(folder) / table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, list):
        return [_cell(v) for v in value]
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=lambda r: [(v is None, str(v)) for v in r])


def spark_rows(df):
    return _rows(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return _rows([d[0] for d in cursor.description], cursor.fetchall())

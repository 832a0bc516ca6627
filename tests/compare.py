"""Run a query and its SQL on the same tables and compare them by value."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(picked, key=repr)


def differences(spark, db, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description."""
    df = query(spark, sf_dir)
    spark_rows = sorted_rows(df.columns, df.collect())
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    sql_rows = sorted_rows(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows != {len(sql_rows)}; {spark_rows[:2]} / {sql_rows[:2]}"
    wrong = [(a, b) for a, b in zip(spark_rows, sql_rows) if repr(a) != repr(b)]
    return f"{len(wrong)} of {len(sql_rows)} rows differ: {str(wrong[0])[:600]}" if wrong else None

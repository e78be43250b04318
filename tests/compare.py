"""Compare a Spark result with the SQL result on the same tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}") + 0.0
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str:
    """Empty when both hold the same rows."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left = rows_of(df.columns, df.collect())
    right = rows_of(names, cursor.fetchall())
    if left == right:
        return ""
    only_left, only_right = left - right, right - left
    return (f"{sum(left.values())} vs {sum(right.values())} rows; only here {sum(only_left.values())}: "
            f"{list(only_left)[:2]}; only there {sum(only_right.values())}: {list(only_right)[:2]}")

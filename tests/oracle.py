"""Side-by-side run of a registered query and its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(round(value, 5) + 0.0, ".5f")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    return str(value)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(normal(r[n]) for n in names) for r in df.collect())


def rows_of_duckdb(con, sql):
    con.execute(sql)
    names = [d[0] for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in con.fetchall())


def difference(df, con, sql) -> str:
    """Empty when equal, otherwise what differs first."""
    left_names, left = rows_of_spark(df)
    right_names, right = rows_of_duckdb(con, sql)
    if left_names != right_names:
        return f"columns {sorted(set(left_names) ^ set(right_names))}"
    if left == right:
        return "" if left else "both are empty"
    only_left = sorted(set(left) - set(right))[:2]
    only_right = sorted(set(right) - set(left))[:2]
    return f"rows {len(left)} vs {len(right)}\n  {left_names}\n  spark  {only_left}\n  duckdb {only_right}"

"""Compare a Spark result with DuckDB's, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """None when equal, else a short description."""
    cursor = con.execute(sql)
    sql_columns = [d[0] for d in cursor.description]
    expected = bag(cursor.fetchall(), sql_columns)
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} vs {sorted(sql_columns)}"
    actual = bag(df.collect(), df.columns)
    if actual == expected:
        return None
    return (
        f"{sum(actual.values())} vs {sum(expected.values())} rows; only Spark: "
        f"{list((actual - expected).items())[:3]}; only SQL: {list((expected - actual).items())[:3]}"
    )

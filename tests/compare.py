"""Rows of a query and of its SQL as multisets of plain values."""

import os
from collections import Counter


def duck(folder):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(folder):
        if t.endswith(".parquet"):
            c.execute(f"create view {t[:-8]} as select * from '{folder}/{t}'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(f"{float(x):.9g}") if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else x


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(connection, sql):
    cur = connection.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())

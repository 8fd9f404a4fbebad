"""Holds a DataFrame against SQL that DuckDB runs on the same tables."""

import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None if v is None else "nan"
    if isinstance(v, bool):
        return v
    if hasattr(v, "__float__") and not isinstance(v, str):
        return round(float(v), 5) + 0.0
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return columns, found.fetchall()


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5


def assert_same(df, sql, sf_dir):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    columns, rows = duck(sql, sf_dir)
    want = rows_of(columns, rows)
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not all(map(close, a, b))]
    assert not bad, bad[:3]

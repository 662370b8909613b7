"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import numbers

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, numbers.Number):
        return "" if v != v else f"{float(v):.6f}"
    return str(v)


def same_rows(df, con, sql: str) -> None:
    got = [r.asDict() for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(names)
    key = sorted(names)
    a, b = (sorted(tuple(_cell(r[c]) for c in key) for r in rows) for rows in (got, want))
    assert len(a) == len(b)
    assert a == b

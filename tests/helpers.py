"""What the tests share: rows as tuples, and the SQL oracle."""

from __future__ import annotations

import glob
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def oracle(sql: str, columns: list[str], sf: str = SF) -> Counter:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {file.rsplit('/', 1)[-1][:-8]} as select * from read_parquet('{file}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    return Counter(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())

"""Comparing a query with its SQL."""

import math
from pathlib import Path


def rows_of(df, columns):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5)
    return str(v)


def assert_same(spark, name, query, sql, sf):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}'")
    got = query(spark, sf)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(got.columns) == sorted(names), name
    want = sorted((tuple(_plain(v) for v in row) for row in result.fetchall()), key=repr)
    assert rows_of(got, names) == want, name

"""Run a query and its DuckDB oracle on the same tables and compare rows."""

import glob
import math
import os

import duckdb


def views(base):
    con = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, sql, con):
    got = df.collect()
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    a, b = rows_of(df.columns, got), rows_of(names, want)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), len(a), sorted(names), bad[:3])
    return len(a)

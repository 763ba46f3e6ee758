"""Rows of a Spark query against rows of SQL in DuckDB."""

from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(v[k]) for k in order) for v in values)


def from_sql(sql, folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    done = c.execute(sql)
    names = [x[0] for x in done.description]
    return sorted(names), rows(names, done.fetchall())


def from_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())

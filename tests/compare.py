"""Rows of a query against rows of its SQL."""

import glob
import math
import os

import duckdb


def sql_rows(sf: str, sql: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return int(x) if isinstance(x, bool) else x

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, sf: str, sql: str) -> int:
    names, rows = sql_rows(sf, sql)
    assert sorted(names) == sorted(df.columns)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    assert mine == normal(names, rows)
    return len(mine)

"""Run a registered query and its SQL side by side and describe every difference."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return ("float", repr(value + 0.0))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, datetime.datetime):
        return ("time", value.isoformat())
    return value


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both engines agree on names, row count and every value."""
    df = query(spark, sf_dir)
    mine = table(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = table(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not mine:
        return "no rows"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; first {mine[:1]} / {theirs[:1]}"
    for a, b in zip(mine, theirs):
        if a != b:
            wrong = [(x, y) for x, y in zip(a, b) if x != y]
            return f"first difference {str(wrong)[:600]} in {str(a)[:300]}"
    return None

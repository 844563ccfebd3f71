"""Compare a query's rows with those of its SQL text."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

from .views import TABLES


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(v):
    """One form for values that the two engines type differently."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """Nothing when columns and rows agree, else what differs."""
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    expected = _rows(names, theirs.fetchall())
    got = _rows(df.columns, df.collect())
    if expected == got:
        return None
    only_here, only_there = got - expected, expected - got
    return (
        f"rows {sum(got.values())} vs {sum(expected.values())}; only here"
        f" {sum(only_here.values())}: {list(only_here)[:2]}; only there"
        f" {sum(only_there.values())}: {list(only_there)[:2]}"
    )

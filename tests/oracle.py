"""Compares a query with its SQL in DuckDB, order aside."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    for p in Path(sf).iterdir():
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.name.split('.')[0]} as select * from '{at}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v) if hasattr(v, "isoformat") else v


def rows_of_sql(c, sql: str, columns: list[str]) -> list[tuple]:
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    return sorted([tuple(plain(x[k]) for k in at) for x in r.fetchall()], key=repr)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted([tuple(plain(r[k]) for k in columns) for r in df.collect()], key=repr)

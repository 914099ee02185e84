"""Runs a registered query and its SQL counterpart and compares whole results."""

from __future__ import annotations

import math
from collections import Counter
from glob import glob
from os.path import basename

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        name = basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.12g}")
    return v


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def _kind(t: str) -> str:
    t = t.lower()
    return {"string": "varchar", "int": "integer", "long": "bigint"}.get(t, t)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else a description of the first differences."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: _kind(str(d[1])) for d in cur.description}
    theirs = _rows(names, cur.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {n: _kind(k) for n, k in df.dtypes}
    if kinds != types:
        diff = {n: (kinds[n], types[n]) for n in kinds if kinds[n] != types[n]}
        return f"types {diff}"
    if ours != theirs:
        only = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
        return f"rows {sum(ours.values())} vs {sum(theirs.values())}; {only}"
    return None

"""Run a registered query and its SQL twin side by side and compare."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    import numbers
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, numbers.Integral):
        return int(v)
    if isinstance(v, (float,)) or type(v).__name__ in ("float64", "float32", "Decimal"):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def key(row):
    return tuple((x is None, f"{x:.5g}" if isinstance(x, float) else str(x)) for x in row)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], out


def kinds(rows):
    out = []
    for col in zip(*rows) if rows else []:
        out.append({type(x).__name__ for x in col if x is not None})
    return out


def compare(spark, con, sf, fn, sql):
    """None when equal, otherwise a short description of the difference."""
    df = fn(spark, sf)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    ks, kd = kinds(sr), kinds(dr)
    for n, a, b in zip(sc, ks, kd):
        if a and b and a != b:
            return f"type of {n}: {a} != {b}"
    if sorted(sr, key=repr) == sorted(dr, key=repr):
        return None
    ds, dd = set(sr), set(dr)
    a, b = sorted(ds - dd, key=repr), sorted(dd - ds, key=repr)
    return f"{len(a)} rows differ of {len(sr)}; spark {a[:2]} oracle {b[:2]}"

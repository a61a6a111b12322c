"""Compares a query with its SQL in DuckDB over the same tables, whatever the order of rows and columns."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def difference(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, str(sf_dir))
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(range(len(names)), key=lambda k: names[k])
    theirs = sorted((tuple(value(r[k]) for k in order) for r in want.fetchall()), key=str)
    ours = sorted((tuple(value(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    if theirs == ours:
        return None
    a, b = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} and {len(theirs)} rows; only ours {a}; only theirs {b}"

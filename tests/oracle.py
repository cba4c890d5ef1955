"""Compares registered queries with their SQL on DuckDB over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        x = float(v)
        return (2, "nan" if math.isnan(x) else f"{x + 0.0:.6g}")
    return (3, str(v.isoformat() if hasattr(v, "isoformat") else v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, con, run, sql, sf_dir):
    """None if alike, else what differs."""
    df = run(spark, sf_dir)
    got = df.collect()
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    want = rel.fetchall()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    if not got:
        return "no rows"
    odd = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    kinds = {n: (k, str(x[1])) for (n, k), x in zip(df.dtypes, sorted(rel.description, key=lambda x: df.columns.index(x[0])), strict=True)}
    mixed = {n: k for n, k in kinds.items() if (k[0] in ("bigint", "int")) != (k[1] in ("BIGINT", "INTEGER", "NUMBER")) or k[1] in ("HUGEINT",)}
    return f"{len(odd)} of {len(a[1])} rows differ, first {odd[0]}" if odd else (f"types {mixed}" if mixed else None)

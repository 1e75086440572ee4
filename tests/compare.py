"""Hold Spark results against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            db.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        return f"{float(v):.6g}" if not isinstance(v, (str, bytes)) else str(v)
    except (TypeError, ValueError):
        return str(v)


def same(got, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if equal, else what differs."""
    want = db.sql(sql)
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} and {sorted(want.columns)}"
    kinds = {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    loose = {"BIGINT": {"bigint"}, "INTEGER": {"int"}, "DOUBLE": {"double"}, "VARCHAR": {"string"}, "BOOLEAN": {"boolean"}}
    odd = [(c, t, kinds[c]) for c, t in got.dtypes if t not in loose.get(kinds[c], {t})]
    if a != b:
        return f"{len(a)} and {len(b)} rows; only Spark: {[x for x in a if x not in set(b)][:2]}; only SQL: {[x for x in b if x not in set(a)][:2]}; types {odd}"
    return f"types {odd}" if odd else ""

"""Compare Spark results with DuckDB's on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """'' if both give the same columns and rows."""
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = dict(zip(names, map(str, rel.types), strict=True))
    mine = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(c, mine[c], kinds[c]) for c in names if same.get(mine[c], mine[c]) != kinds[c]]
    a, b = rows_of(df.columns, df.collect()), rows_of(names, rel.fetchall())
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        missing = [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only here {extra}; only there {missing}"
    return f"types {odd}" if odd else ""

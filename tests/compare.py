"""Run a query on Spark and its SQL on DuckDB and compare rows as multisets."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(frame, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(frame.columns)
    arrow = frame.select(*[f"`{n}`" for n in names]).toArrow()
    expected = con.sql(sql).to_arrow_table()
    if sorted(expected.column_names) != names:
        return f"columns {names} and {sorted(expected.column_names)}"
    left = list(zip(*[arrow.column(n).to_pylist() for n in names]))
    right = list(zip(*[expected.column(n).to_pylist() for n in names]))
    if len(left) != len(right):
        return f"{len(left)} rows and {len(right)}"
    if not left:
        return "both are empty"
    if Counter(left) != Counter(right):
        ours = list((Counter(left) - Counter(right)).items())[:3]
        theirs = list((Counter(right) - Counter(left)).items())[:3]
        return f"only Spark: {ours}\nonly DuckDB: {theirs}"
    types = [(n, str(arrow.schema.field(n).type), str(expected.schema.field(n).type)) for n in names]
    odd = [t for t in types if t[1].replace("large_", "") != t[2].replace("large_", "")]
    return f"types {odd}" if odd else None

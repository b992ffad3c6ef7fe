"""Run queries next to their SQL in DuckDB and compare by value."""
from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return (1, "")
    if isinstance(value, bool):
        return (0, str(value))
    if isinstance(value, float):
        return (0, "nan" if math.isnan(value) else f"{value + 0.0:.6f}")
    return (0, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, run, sql) -> tuple[bool, str]:
    t = time.time()
    df = run(spark, folder)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return True, f"{len(left[1])} rows, no SQL, {spent:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    right = _rows([d[0] for d in cur.description], cur.fetchall())
    note = f"{len(left[1])} rows, spark {spent:.1f}s, sql {time.time() - t:.1f}s"
    if left == right:
        return True, note
    if left[0] != right[0]:
        return False, f"columns {left[0]} / {right[0]}"
    only_l = sorted(set(left[1]) - set(right[1]))[:3]
    only_r = sorted(set(right[1]) - set(left[1]))[:3]
    return False, f"{note}; {len(left[1])} / {len(right[1])} rows; spark {only_l}; sql {only_r}"

"""Runs a registered query and its SQL check side by side and reports the first difference."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A cell in a form that both engines share, strict about everything but the integer width."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "fnan"
        return f"f{value + 0.0!r}" if value else "f0.0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return f"t{value.isoformat()}"
    return f"s{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, con, sf_dir, fn, sql) -> str | None:
    """None if both sides give the same columns and rows."""
    df = fn(spark, sf_dir)
    left_columns = df.columns
    left = rows_of(left_columns, [tuple(r) for r in df.collect()])
    relation = con.execute(sql)
    right_columns = [d[0] for d in relation.description]
    right = rows_of(right_columns, relation.fetchall())
    if sorted(left_columns) != sorted(right_columns):
        return f"columns differ: {sorted(left_columns)} vs {sorted(right_columns)}"
    if len(left) != len(right):
        return f"row counts differ: {len(left)} vs {len(right)}; first {left[:2]} vs {right[:2]}"
    if not left:
        return "both sides are empty"
    for a, b in zip(left, right):
        if a != b:
            return f"rows differ ({sorted(left_columns)}):\n  spark  {a}\n  check  {b}"
    return None

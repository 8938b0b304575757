"""Runs a query and its SQL twin over the same tables and compares rows, names and types."""

from __future__ import annotations

import math

import duckdb

from textquarry.tables import NAMES


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in NAMES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(plain(x) for x in value.values()) + "}"
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def difference(db, spark_df, sql: str) -> str:
    """Empty if equal, else what differs first."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    got = rows_of(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{str(a)[:300]} against {str(b)[:300]}"
    return ""

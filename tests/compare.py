"""Side-by-side check of a Spark result and a SQL result."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return f"{x + 0.0:.9g}"
    if isinstance(x, dt.datetime):
        return x.isoformat(sep=" ")
    return str(x)


def normalise(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    want_cols, want = normalise([d[0] for d in found.description], found.fetchall())
    got_cols, got = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return [f"columns {got_cols} instead of {want_cols}"]
    if len(got) != len(want):
        return [f"{len(got)} rows instead of {len(want)}"]
    return [f"{g} instead of {w}" for g, w in zip(got, want) if g != w][:5]

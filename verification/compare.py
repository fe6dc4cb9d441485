"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from verification.queries import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.astimezone(dt.UTC).replace(tzinfo=None)
    return v


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got_columns, got = df.columns, df.collect()
    if name not in ORACLE:
        return None
    cur = con.execute(ORACLE[name])
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = _rows(got_columns, got), _rows(want_columns, want)
    if a == b:
        return None
    extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{len(got)} vs {len(want)} rows; columns {sorted(got_columns)}; only ours {extra}; only SQL {missing}"

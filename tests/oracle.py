"""Runs a registered query and its SQL twin on the same files and compares their rows as multisets."""

import datetime
import math
import os
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(text(r[i]) for i in order) for r in values)


def assert_same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    want = connect(sf_dir).sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())

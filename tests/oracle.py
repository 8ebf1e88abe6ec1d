"""Spark rows against DuckDB rows on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def duck(sf_dir: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = c.sql(sql)
    return sorted(r.columns), rows(r.columns, r.fetchall())


def same(df, sf_dir: str, sql: str):
    names, want = duck(sf_dir, sql)
    assert sorted(df.columns) == names
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want

"""Runs a query in Spark and its SQL in DuckDB and compares the rows as the driver does: by column name, any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def differs(spark, name, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} / {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows / {len(want)}; {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b)):
            return f"{name}: {a} / {b}"
    exact = sum(a != b for a, b in zip(got, want))
    return f"{name}: {exact} rows differ in the last digits: " + str(next((a, b) for a, b in zip(got, want) if a != b)) if exact else ("" if got else f"{name}: no rows")

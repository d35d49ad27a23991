"""Compare a query with its SQL in DuckDB: columns, rows in any order, values to the last rounded place."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


def differs(spark, c, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    r = c.sql(sql)
    want = rows_of(r.columns, r.fetchall())
    if sorted(df.columns) != sorted(r.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(r.columns)}"
    if got != want:
        odd = [x for x in zip(got, want, strict=False) if x[0] != x[1]][:2]
        return f"{name}: {len(got)} and {len(want)} rows, {odd}"
    return None

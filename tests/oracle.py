"""Comparison of a Spark result with DuckDB's, as the driver makes it: columns by name, rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    place = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=str)
    assert got == want
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for c, k in df.dtypes:
        assert KINDS.get(k, kinds[c]) == kinds[c], (c, k, kinds[c])
    return len(got)

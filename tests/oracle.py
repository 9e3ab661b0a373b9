"""Spark's rows of a query against DuckDB's rows of its SQL."""

import os

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names)
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=str)
    want = sorted(([plain(x) for x in r] for r in want.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b, f"{a}\n{b}"
    return len(got)

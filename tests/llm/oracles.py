"""A query's rows against its oracle SQL."""

import os

import duckdb


def same(spark, query, sql, sf="/root/testdata/sf0.01", tables=("documents", "pages", "labels", "embeddings", "benchmark", "conversations")):
    con = duckdb.connect()
    for t in tables:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    df = query(spark, sf)
    assert sorted(df.columns) == names
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w
    return want

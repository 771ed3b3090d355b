"""Compares a Spark result with the rows of a DuckDB query over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None or v != v else v


def same(df, sql: str, sf_dir: str) -> None:
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = c.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(x) for x in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    ours = sorted(repr(tuple(plain(r[x]) for x in columns)) for r in df.collect())
    assert len(ours) == len(theirs)
    assert ours == theirs

"""Run a query and its SQL and compare the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def _plain(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


def same(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(_plain, got)) == sorted(map(_plain, want))

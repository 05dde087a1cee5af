"""Compare a query with its DuckDB SQL over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else None if v is None else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def oracle_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(str(tuple(plain(x[k]) for k in at)) for x in r.fetchall())

"""Runs a query beside its SQL on DuckDB and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_spark(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def rows_of_sql(sql, folder, tables=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, frame in (tables or {}).items():
        con.register(f"_{name}", frame)
        con.execute(f"create or replace view {name} as select * from _{name}")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(r[k] for k in order)) for r in cur.fetchall())

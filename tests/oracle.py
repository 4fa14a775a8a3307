"""Running a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], found: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def both(spark, sf: str, query, sql: str) -> tuple:
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(sf).execute(sql)
    names = [d[0] for d in cursor.description]
    return (sorted(df.columns), got), (sorted(names), rows(names, cursor.fetchall()))

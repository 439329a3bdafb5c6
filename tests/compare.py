"""Rows of a query against rows of DuckDB, without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return int(v) if type(v).__name__.startswith(("int", "uint")) else v if isinstance(v, (int, str, bool)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)

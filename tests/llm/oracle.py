"""Compares a registered query with its DuckDB SQL on the tables of a folder."""

import glob
import os

import duckdb

from panelspark.llm import queries as Q


def same_rows(spark, name, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    df = Q.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    res = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.oracle_sql()[name]})")
    want, got = res.fetchall(), [tuple(r) for r in df.select(*cols).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return df

"""Compares a Spark result with DuckDB's for the query's SQL, as bags of rows by column name."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = con.sql(sql)
    assert sorted(result.columns) == cols
    at = [result.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert len(got) == len(want)
    assert not [pair for pair in zip(got, want, strict=True) if pair[0] != pair[1]][:3]

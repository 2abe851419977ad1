"""Compare a query with its DuckDB SQL, whatever the order of rows and columns."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(pdf, columns):
    pdf = pdf[columns].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    plain = lambda v: int(v) if isinstance(v, float) and v == int(v) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in pdf.itertuples(index=False, name=None))


def same(spark, sf_dir: str, query, sql: str) -> int:
    a, b = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))
    return len(a)

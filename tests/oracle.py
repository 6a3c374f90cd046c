"""Compares a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def rows(columns, found):
    return sorted(str([r[c] for c in columns]) for r in found)


def same(spark, folder, f, sql):
    df = f(spark, folder)
    columns = sorted(df.columns)
    got = rows(columns, [r.asDict() for r in df.collect()])
    relation = connect(folder).sql(sql)
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    assert got == rows(columns, [dict(zip(names, r, strict=True)) for r in relation.fetchall()])

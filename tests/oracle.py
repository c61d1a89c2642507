"""Compares a query with its SQL twin as the driver does: rows, columns and values, in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, text):
    df = query(spark, sf_dir)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(sf_dir).execute(text)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(have) == len(want), (len(have), len(want))
    for a, b in zip(have, want):
        assert a == b
    return len(have)

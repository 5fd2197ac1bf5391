"""A query's SQL on the same tables, compared value by value."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.isdir(p):
            p += "/*.parquet"
        c.sql(f"create view {t} as select * from '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in values)


def same(frame, sql, folder):
    """The rows, as dictionaries, once both sides agree."""
    want = connect(folder).sql(sql)
    got = frame.collect()
    assert sorted(want.columns) == sorted(frame.columns)
    assert rows(frame.columns, got) == rows(want.columns, want.fetchall())
    return [r.asDict() for r in got]

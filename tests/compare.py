"""A query's rows against those of its SQL, in any order, as text."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(str(x.item() if hasattr(x, "item") else x) for x in row) for row in frame.itertuples(index=False))


def check(spark, query, sql):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(path := f"{FOLDER}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    got, want = rows_of(query(spark, FOLDER).toPandas()), rows_of(con.sql(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]

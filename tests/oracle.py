"""Compares a query's rows with those of its SQL, order and last digits aside."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([canon(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    return str(v)


def compare(df, sql, sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = df.toPandas(), c.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(tuple(map(canon, r)) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (got, want)]
    assert rows[0] == rows[1]

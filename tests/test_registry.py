"""Every registered query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import glob
import math
import os
import threading

import duckdb
import pytest

from quellwerk.plans.registry import ORACLE_SQL, QUERIES
import quellwerk.plans  # noqa: F401  registers


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v or str(v) in ("<NA>", "NaT") else round(float(v), 5) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v)
    return sorted((tuple(clean(v) for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got.columns)
    if name in ORACLE_SQL:
        timer = threading.Timer(60, duck.interrupt)
        timer.start()
        try:
            wanted = duck.execute(ORACLE_SQL[name]).df()
        finally:
            timer.cancel()
        assert sorted(got.columns) == sorted(wanted.columns)
        a, b = rows_of(got), rows_of(wanted)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, abs_tol=2e-5)) for p, q in zip(x, y)), (x, y)

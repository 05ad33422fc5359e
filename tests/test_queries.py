"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from strataflow.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return "NULL"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        if math.isnan(x):
            return "NULL"
        return f"{x:.6g}"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{x:.6g}"
    return str(x)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_against_sql(name, spark, duck):
    q = REGISTRY[name]
    ours, theirs = q.run(spark, SF).toPandas(), duck.execute(q.sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

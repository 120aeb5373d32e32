"""Every registered query with SQL gives what DuckDB gives over the same tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from sievegrid.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer events documents embeddings pages benchmark labels conversations part".split()


def rows(df):
    df = df[sorted(df.columns)]
    # whole numbers beside nulls come as floats from one side and as nullable integers from the other
    clean = lambda v: None if pd.isna(v) else float(v) + 0.0 if isinstance(v, numbers.Real) and not isinstance(v, bool | np.bool_) else v
    return sorted(repr(tuple(clean(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    assert rows(got) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["video_id", "t", "token", "score"]
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())

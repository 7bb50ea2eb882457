import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.operators import events, series
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_as_sql_says(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    same = lambda d: d[columns].astype({c: "float64" for c in columns if pd.api.types.is_numeric_dtype(d[c])}).sort_values(columns, ignore_index=True)
    pd.testing.assert_frame_equal(same(got), same(want), check_dtype=False, rtol=1e-6)


def test_a_gap_that_equals_the_limit_merges(spark):
    hits = spark.createDataFrame([(1, i, t, 0.5, 0.5) for i, t in enumerate([0.0, 3.2, 6.5])], "media_id long, hit_idx long, t double, strength double, confidence double")
    assert sorted(r.n for r in events.clusters(hits, 3.2, 1).collect()) == [1, 2]


def test_hysteresis_wants_ordered_thresholds(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "media_id long, idx long, value double")
    with pytest.raises(ValueError):
        series.hysteresis(df, 2.0, 1.0)

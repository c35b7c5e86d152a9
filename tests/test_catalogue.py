"""Every query with SQL equals DuckDB's result on the smallest tables; the others give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxlake.plans import agreement, catalogue, derived, modules, profiles, response  # noqa: F401


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, data, duck, name):
    ours, want = catalogue.QUERIES[name](spark, data).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(ours.columns) == columns
    ours, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, want))
    for c in columns:
        if "datetime" in str(ours[c].dtype):
            ours[c], want[c] = ours[c].astype("datetime64[us]"), want[c].astype("datetime64[us]")
    pd.testing.assert_frame_equal(ours, want, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_level_of_large_prices_equals_sql(spark, data, tmp_path):
    """All probabilities are 1, as at sf0.1: there is no level set, so no rows."""
    table = f"{tmp_path}/lineitem.parquet"
    spark.read.parquet(f"{data}/lineitem.parquet").withColumn("l_extendedprice", F.col("l_extendedprice") + 50000).write.parquet(table)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{table}/*.parquet'")
    want = con.execute(catalogue.ORACLES["probability_level"]).fetchall()
    assert catalogue.QUERIES["probability_level"](spark, str(tmp_path)).count() == len(want) == 0

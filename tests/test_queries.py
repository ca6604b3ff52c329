"""Every registered analytics query against its SQL counterpart, over the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from bayline.plans import catalogue


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, np.ndarray | list):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, float | np.floating):
            return round(float(v), 6)
        return v.item() if isinstance(v, np.generic) else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(found.columns)
    if name in catalogue.ORACLES:
        expected = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows_of(found) == rows_of(expected)


def test_entry_runs_at_the_smallest_scale(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_native_queries_have_no_python(spark, sf_dir):
    for name in ("run_breakdown", "coverage_links", "threshold_grid", "fusion_logodds", "polygon_validity_reason", "quarantine_v2"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name

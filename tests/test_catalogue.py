import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", catalogue.queries())
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, D).toPandas()
    if name not in catalogue.oracle_sql():
        assert len(got)
        return
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) and len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=2e-6)

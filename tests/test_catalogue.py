import duckdb
import numpy as np
import pytest

from tallyframe import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalogue.ORACLE_SQL:
        return
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert (got[c].isna() == want[c].isna()).all()
        a, b = got[c].dropna(), want[c].dropna()
        if a.dtype.kind in "fi" and b.dtype.kind in "fi":
            assert np.allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=2e-6), c
        else:
            assert (a.astype(str) == b.astype(str)).all(), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60

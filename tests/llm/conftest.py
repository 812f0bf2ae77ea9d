import pandas as pd
import pytest


@pytest.fixture
def frame(spark):
    """Rows with extra columns whose names clash with results."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def same_as_sql(spark, duck):
    """Compares a query's rows with those of its SQL at the smallest size."""

    def check(query, sql, at="/root/testdata/sf0.001"):
        got, want = query(spark, at).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        plain = lambda x: None if x is None or x is pd.NA or x != x else (str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
        rows = lambda f: sorted(tuple(plain(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
        assert rows(got) == rows(want)

    return check

"""Every query of the registry operators against its SQL, at the smallest size."""

import pandas as pd
import pytest

from veristry.plans import complete, content, indexed, lists, more, registry, statistics  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def plain(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return round(float(x), 5) + 0.0
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(([plain(x) for x in r] for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0

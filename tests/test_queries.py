"""Every query of the transcript engine against its SQL on a second engine."""

from __future__ import annotations

import pandas as pd
import pytest

from turnloom.plans.registry import QUERIES, SQL


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order; missing values and lists alike on both sides."""
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, second, name):
    ours, theirs = QUERIES[name](spark, small).toPandas(), second.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    pd.testing.assert_frame_equal(plain(ours), plain(theirs), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0

import pytest

import __spark_entry__ as E
from tabwright import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and df.columns == ["col_name", "abs_corr", "rank"]


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_runs_whole(spark, sf, name):
    df = E.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()

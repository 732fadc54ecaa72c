"""Every query of the engine that SQL can express equals its DuckDB counterpart."""

import pytest

from millrace.plans import catalogue
from tests.conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got), "an empty result shows nothing"
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_oracle(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

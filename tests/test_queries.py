"""Every query with SQL gives DuckDB's rows; the others run."""

import pytest

import __spark_entry__ as registry
from cairn.plans import queries as plans

from .compare import same


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, sf, duck, name):
    same(plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())

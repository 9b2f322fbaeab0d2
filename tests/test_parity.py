"""Every query that SQL can express gives the rows of its SQL."""

import importlib
import pkgutil

import pytest
from parity import both, views

import millrace.plans

MODULES = [importlib.import_module(f"millrace.plans.{m.name}") for m in pkgutil.iter_modules(millrace.plans.__path__)]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, data, name):
    mine, theirs = both(spark, con, QUERIES[name], ORACLE[name], data)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert QUERIES.keys() <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()

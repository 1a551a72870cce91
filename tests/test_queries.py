"""Every registered query runs, and equals its SQL where there is some."""

import importlib
import pkgutil

import pytest

import geoloom.plans
from geoloom.plans import registry

from tests.compare import SF, compare

for m in pkgutil.iter_modules(geoloom.plans.__path__):
    importlib.import_module(f"geoloom.plans.{m.name}")

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(spark, SF, registry.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0

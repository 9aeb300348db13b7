"""Every registered query against its SQL at the smallest scale."""

import importlib.util
import os

import pytest

import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from apexgrid.plans import oracle
from apexgrid.plans import queries as registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = entry.SMOKE_DIR

spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "tools", "check_oracle.py"))
check_oracle = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check_oracle)


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF_DIR)


def test_registries_match():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF_DIR)
    assert check_oracle.differences(got.toPandas(), con.execute(oracle.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

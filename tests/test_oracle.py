"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import os
from functools import partial

import pytest

import __spark_entry__ as entry
from compare import connect, differences

from tabscope.plans.training import train_candidates
from tabscope.queries import training

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    """SQL checks what holds of any fitted model; that the queries train 200 trees has a test of its own."""
    monkeypatch.setattr(training, "train_candidates", partial(train_candidates, n_trees=3))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, name, QUERIES[name], ORACLE[name], SF) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
